"""Nearest neighbours by score-aware (anisotropic) quantisation with four-bit table scans and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common, vectors

#: Vectors for each coarse list, most lists, rows of one scan block, candidates reranked at once.
PER_LIST, MOST_LISTS, BLOCK, RERANK = 1500, 1024, 8192, 48
#: Dimensions of a four-bit subspace; the score threshold that sets how much parallel error weighs.
SUBSPACE, THRESHOLD = 2, 0.2
#: The share of a sample's true neighbours that the calibrated number of probes must reach.
CALIBRATED = 0.98
#: Queries held back for that calibration.
TRIALS = 400


class AnisotropicQuantiser:
    """Four-bit codebooks that minimise orthogonal error plus `eta` times the error parallel to the vector.

    Only the parallel part moves an inner product with a query that the vector answers well, so it weighs
    eta = (dim - 1) * t^2 / (1 - t^2) times as much for a score threshold t.
    """

    def __init__(self, sample: np.ndarray, threshold: float = THRESHOLD, rounds: int = 4):
        dim = sample.shape[1]
        self.cuts = vectors.cuts(dim, -(-dim // SUBSPACE))
        self.eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        self.books = [vectors.kmeans(sample[:, c], 16, 4) for c in self.cuts]
        for _ in range(rounds):
            codes = self.encode(sample)
            held = self.decode(codes)
            for k, c in enumerate(self.cuts):
                x, u, width = sample[:, c], sample[:, c], c.stop - c.start
                others = ((sample - held) * sample).sum(axis=1) - ((x - held[:, c]) * u).sum(axis=1)
                weight = (self.eta - 1) * u[:, :, None] * u[:, None, :] + np.eye(width)
                target = (weight @ x[:, :, None])[:, :, 0] + ((self.eta - 1) * others)[:, None] * u
                for code in np.unique(codes[:, k]):
                    at = codes[:, k] == code
                    self.books[k][code] = np.linalg.solve(weight[at].sum(axis=0) + 1e-9 * np.eye(width), target[at].sum(axis=0))
                held[:, c] = self.books[k][codes[:, k]]

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, as the parallel error couples the subspaces."""
        codes = np.stack([vectors.nearest(x[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1)
        parallel = ((x - self.decode(codes)) * x).sum(axis=1)
        for _ in range(passes):
            for k, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
                part = x[:, c]
                along = (part * part).sum(axis=1)[:, None] - part @ book.T
                others = parallel - along[np.arange(len(x)), codes[:, k]]
                error = (part * part).sum(axis=1)[:, None] - 2 * part @ book.T + (book * book).sum(axis=1)
                codes[:, k] = (error + (self.eta - 1) * (others[:, None] + along) ** 2).argmin(axis=1)
                parallel = others + along[np.arange(len(x)), codes[:, k]]
        return codes.astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes in a byte."""
        if codes.shape[1] % 2:
            codes = np.c_[codes, np.zeros(len(codes), np.uint8)]
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For a query, the inner product that each byte of packed codes stands for: (bytes, 256)."""
        single = [np.r_[q[c] @ b.T, np.zeros(16 - len(b))] for c, b in zip(self.cuts, self.books, strict=True)]
        if len(single) % 2:
            single.append(np.zeros(16))
        return np.stack([(single[k][:, None] + single[k + 1][None, :]).ravel() for k in range(0, len(single), 2)]).astype(np.float32)


def best(q: np.ndarray, query_id: int, ids: np.ndarray, units: np.ndarray, packed: np.ndarray, scan: AnisotropicQuantiser, k: int) -> list[tuple[int, float]]:
    """The k rows with the largest cosine found, ties to the smaller id; ids ascend.

    The table scan orders all rows; the first RERANK get exact scores. Then every other row whose looked-up score is
    within three deviations of the scan's error of the k-th exact score is reranked as well, however many they are.
    """
    tables = scan.tables(q)
    rough = np.zeros(len(ids), np.float32)
    for b in range(packed.shape[1]):
        rough += tables[b][packed[:, b]]
    rough[ids == query_id] = -np.inf
    first = np.argpartition(-rough, RERANK)[:RERANK] if len(ids) > RERANK else np.arange(len(ids))
    exact = units[first] @ q
    off = exact - rough[first]
    slack = 3 * float(np.sqrt((off[np.isfinite(off)] ** 2).mean())) if np.isfinite(off).any() else 0.0
    exact[ids[first] == query_id] = -np.inf
    floor = np.sort(exact)[-k] if len(exact) >= k else -np.inf
    more = np.flatnonzero(rough >= floor - slack) if len(ids) > RERANK else first
    at = np.union1d(first, more)
    at = at[ids[at] != query_id]
    score = np.clip(units[at] @ q, -1, 1)
    top = np.lexsort((ids[at], -score))[:k]
    return [(int(ids[at[t]]), float(score[t])) for t in top]


def calibrate(sample: np.ndarray, centres: np.ndarray, k: int) -> int:
    """Lists to probe so that a sample's k nearest are reached to the share CALIBRATED.

    A copy-rich corpus is denser than its sample, which only brings neighbours nearer.
    """
    trials = sample[:TRIALS]
    score = trials @ sample.T
    score[np.arange(len(trials)), np.arange(len(trials))] = -2
    near = np.argpartition(-score, min(k, len(sample) - 1), axis=1)[:, :k]
    own = (sample @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
    rank = np.argsort(np.argsort(-(trials @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(CALIBRATED * len(needed)))]) + 1


SCHEMA = "query_id long, vec_id long, score double"


def nearest_neighbours(table: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k nearest by cosine of each row whose vec_id is divisible by `every`: query_id, rank, vec_id, score.

    table: vec_id (unique), embedding; other columns are ignored. All rows of the query's length but its own are
    candidates. Coarse lists come from a bounded sample, and so does the number of lists probed (calibrate()); all rows
    are indexed, and a query whose lists hold fewer than k others probes on until they do. Vectors that are null, empty,
    zero or hold null or non-finite components take no part. Fewer than k candidates give fewer rows; an empty table gives
    none. Rows that repeat a vec_id are one candidate each; a query's own id is never among its neighbours.
    """
    good = common.checkpoint(vectors.usable(table))
    found = table.sparkSession.createDataFrame([], SCHEMA)
    for rows, n in vectors.by_length(good):
        found = found.unionByName(search(rows, n, k, every))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(good: DataFrame, n: int, k: int, every: int) -> DataFrame:
    """SCHEMA rows: the best of each block that a query meets, of n vectors (vec_id, v) of one length."""
    sample = vectors.sample(good, "vec_id")
    centres = vectors.kmeans(sample, int(np.clip(n // PER_LIST, 1, min(MOST_LISTS, max(1, len(sample) // 64)))))
    probes = min(len(centres), calibrate(sample, centres, k)) if len(sample) > 50 * k else len(centres)
    scan = AnisotropicQuantiser(sample)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = vectors.nearest(vectors.unit(vectors.matrix(batch.column("v"))), centres) if batch.num_rows else np.zeros(0, np.int64)
            lists, count = np.unique(own, return_counts=True)
            yield pa.record_batch([pa.array(lists, pa.int32()), pa.array(count, pa.int64())], names=["list", "n"])

    sizes = dict(good.mapInArrow(home, "list int, n long").groupBy("list").agg(F.sum("n")).collect())
    held = np.array([sizes.get(c, 0) for c in range(len(centres))])
    blocks = -(-held // BLOCK)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column("vec_id").to_numpy(), vectors.matrix(batch.column("v"))
            x = vectors.unit(v)
            own = vectors.nearest(x, centres)
            block = (ids * 2654435761 % 2**31) % blocks[own]
            packed = scan.packed(scan.encode(x))
            out: list[tuple[int, int, bytes, bytes | None]] = []
            slot = own * int(blocks.max() + 1) + block
            order = np.argsort(slot, kind="stable")
            for s, e in zip(*common.runs_of(slot[order]), strict=True):
                at = order[s:e]
                out.append((int(own[at[0]]), int(block[at[0]]), common.pack(id=ids[at], codes=packed[at].ravel().view(f"V{packed.shape[1]}"), x=x[at].ravel().view(f"V{8 * x.shape[1]}")), None))
            asked = np.flatnonzero(ids % every == 0)
            if len(asked):
                order = np.argsort(-(x[asked] @ centres.T), axis=1, kind="stable")
                ahead = np.cumsum(held[order], axis=1) - held[order]  # vectors in the lists before each, the query perhaps among them
                probed = (np.arange(len(centres)) < probes) | (ahead <= k)
                row, slot = np.nonzero(probed)
                for c in np.unique(order[probed]).tolist():
                    at = asked[row[order[row, slot] == c]]
                    body = common.pack(id=ids[at], x=x[at].ravel().view(f"V{8 * x.shape[1]}"))
                    out += [(c, b, None, body) for b in range(int(blocks[c]))]
            columns = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["list", "block", "rows", "queries"])

    def search_block(part: pa.Table) -> pa.Table:
        def read(name: str) -> dict[str, np.ndarray]:
            return common.unpack_all([p for p in part.column(name).to_pylist() if p is not None])

        rows, asked, out = read("rows"), read("queries"), []
        if rows and asked:
            order = np.argsort(rows["id"])
            ids = rows["id"][order]
            x = np.frombuffer(rows["x"].tobytes(), "<f8").reshape(len(ids), -1)[order]
            packed = np.frombuffer(rows["codes"].tobytes(), np.uint8).reshape(len(ids), -1)[order]
            for query, q in zip(asked["id"].tolist(), np.frombuffer(asked["x"].tobytes(), "<f8").reshape(len(asked["id"]), -1), strict=True):
                out += [(query, i, s) for i, s in best(q, query, ids, x, packed, scan, k)]
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    dealt = good.mapInArrow(deal, "list int, block int, rows binary, queries binary")
    return dealt.groupBy("list", "block").applyInArrow(search_block, SCHEMA)
