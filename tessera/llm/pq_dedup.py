"""Embedding near-duplicates by product quantisation with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, vectors

#: Vectors for each inverted list, most lists, subspaces, centroids of each, and members compared in one task.
PER_LIST, MOST_LISTS, SUBSPACES, CODES, BLOCK = 400, 1024, 16, 256, 4096
#: A vector visits the lists whose border lies within this many standard deviations of a duplicate's displacement.
DEVIATIONS = 2.5
ROWS = "list int, i int, j int, payload binary"


def spread(residual: np.ndarray) -> float:
    """In how many directions the vectors of a list differ: the participation ratio of the residuals' variances, from 1 to
    their dimensions. Vectors that fill a subspace only are displaced along its few directions, so further along each."""
    of_rows = residual.T @ residual
    squares = float((of_rows**2).sum())
    return max(1.0, float(np.trace(of_rows)) ** 2 / squares) if squares > 0 else 1.0


class Quantiser:
    """Coarse centroids, residual codebooks and the lists that a vector must visit."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float):
        self.centres = vectors.kmeans(sample, int(np.clip(n // PER_LIST, 1, min(MOST_LISTS, max(1, len(sample) // 16)))))
        residual = sample - self.centres[vectors.nearest(sample, self.centres)]
        self.cuts = vectors.cuts(sample.shape[1], SUBSPACES)
        self.books = [vectors.kmeans(residual[:, c], CODES, 4) for c in self.cuts]
        # a linked unit vector is at most `radius` away; its part along one of d directions has deviation radius / sqrt(d)
        radius = np.sqrt(2 - 2 * cosine)
        self.margin = radius * min(1.0, DEVIATIONS / np.sqrt(spread(residual)))
        squares = (self.centres**2).sum(axis=1)
        self.apart = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * self.centres @ self.centres.T, 0))

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own list, and a row of booleans: lists whose dividing plane to the own one is within the margin."""
        d = (self.centres**2).sum(axis=1) - 2 * (x @ self.centres.T)
        own = d.argmin(axis=1)
        near = d - d[np.arange(len(x)), own][:, None] <= 2 * self.margin * self.apart[own]
        near[np.arange(len(x)), own] = True
        return own, near

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes, and how far each vector is from what its codes stand for."""
        residual = x - self.centres[own]
        codes = np.stack([vectors.nearest(residual[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        held = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((residual - held) ** 2).sum(axis=1))


def compare(q: Quantiser, own_list: int, same: bool, m: dict, o: dict, cosine: float):
    """Links between the members m and the others o of one block pair: indices into m and o, each pair once."""
    a_all, b_all = [], []
    for at in range(0, len(o["id"]), 256):
        x = o["unit"][at : at + 256]
        score = np.repeat((x @ q.centres[own_list])[:, None], len(m["id"]), axis=1).astype(np.float32)
        for k, (c, book) in enumerate(zip(q.cuts, q.books, strict=True)):
            score += (x[:, c] @ book.T).astype(np.float32)[:, m["codes"][:, k]]
        # the true cosine is within a member's code error of the looked-up one
        maybe = score + m["error"][None, :].astype(np.float32) >= cosine - 1e-4
        home = o["home"][at : at + 256]
        visitor = home != own_list
        maybe &= np.where(visitor[:, None], ~((home < own_list)[:, None] & m["near"][:, home].T), m["id"][None, :] < o["id"][at : at + 256, None] if same else True)
        b, a = np.nonzero(maybe)
        if not len(a):
            continue
        if len(a) > 0.2 * maybe.size:
            dots = (o["v"][at : at + 256] @ m["v"].T)[b, a]
        else:
            dots = np.concatenate([np.einsum("ij,ij->i", o["v"][at + b[s : s + 100_000]], m["v"][a[s : s + 100_000]]) for s in range(0, len(a), 100_000)])
        good = dots >= cosine * o["norm"][at + b] * m["norm"][a]
        a_all.append(a[good])
        b_all.append(at + b[good])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a_all), np.concatenate(b_all)) if a_all else (none, none)


SCHEMA = "a long, b long, links long"


def links(distinct: DataFrame, n: int, cosine: float) -> DataFrame:
    """n rows distinct (id, v, n) of one length to rows (a, b, links): b not null: a link of a spanning forest; else a's weighted links of one block."""
    q = Quantiser(vectors.sample(distinct, "id"), n, cosine)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, _ = q.visits(vectors.unit(vectors.matrix(batch.column("v")))) if batch.num_rows else (np.zeros(0, np.int64), None)
            lists, count = np.unique(own, return_counts=True)
            yield pa.record_batch([pa.array(lists, pa.int32()), pa.array(count, pa.int64())], names=["list", "n"])

    sizes = dict(distinct.select("v").mapInArrow(home, "list int, n long").groupBy("list").agg(F.sum("n")).collect())
    blocks = np.array([-(-sizes.get(k, 0) // BLOCK) for k in range(len(q.centres))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ident, n_copies, v = batch.column("id").to_numpy(), batch.column("n").to_numpy(), vectors.matrix(batch.column("v"))
            x = vectors.unit(v)
            own, near = q.visits(x)
            near &= blocks[None, :] > 0
            codes, error = q.encode(x, own)
            cast, rows = ident * 2654435761 % 2**31, []
            row, lists = np.nonzero(near)
            order = np.argsort(lists, kind="stable")
            for s, e in zip(*common.runs_of(lists[order]), strict=True):
                r, k = row[order[s:e]], int(lists[order[s]])
                block = cast[r] % blocks[k]
                for b in np.unique(block).tolist():
                    at = r[block == b]
                    body = common.pack(id=ident[at], n=n_copies[at], home=own[at].astype(np.int32), error=error[at], codes=codes[at].ravel().view(f"V{codes.shape[1]}"), near=np.packbits(near[at], axis=1).ravel().view(f"V{-(-len(blocks) // 8)}"), v=v[at].ravel().view(f"V{8 * v.shape[1]}"))
                    for other in range(int(blocks[k])):
                        rows.append((k, b, other, body))  # as members (i) and, in i = j, as the others too
                        if other != b:
                            rows.append((k, other, -b - 1, body))  # as the others (j) of another block's members
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], names=["list", "i", "j", "payload"])

    def block_pair(table: pa.Table) -> pa.Table:
        k, payloads, roles = table.column("list")[0].as_py(), table.column("payload").to_pylist(), table.column("role").to_pylist()
        first, second = table.column("i")[0].as_py(), table.column("jj")[0].as_py()

        def rows(bodies: list[bytes]) -> dict[str, np.ndarray]:
            c = common.unpack_all(bodies)
            size = len(c["id"])
            c["codes"] = np.frombuffer(c["codes"].tobytes(), np.uint8).reshape(size, -1)
            c["near"] = np.unpackbits(np.frombuffer(c["near"].tobytes(), np.uint8).reshape(size, -1), axis=1)[:, : len(blocks)].astype(bool)
            c["v"] = np.frombuffer(c["v"].tobytes(), "<f8").reshape(size, -1)
            c["unit"] = vectors.unit(c["v"])
            c["v"] = c["v"] / np.abs(c["v"]).max(axis=1, keepdims=True)  # a power of the length alone; cosines stay
            c["norm"] = np.sqrt((c["v"] ** 2).sum(axis=1))
            return c

        both = rows([p for p, r in zip(payloads, roles, strict=True) if r == 0])
        at_home = both["home"] == k
        m = {name: c[at_home] for name, c in both.items()}
        if first == second:
            o, same = both, True
        else:  # members of two blocks meet once, visitors of the second block meet the first's members
            bodies = [p for p, r in zip(payloads, roles, strict=True) if r == 1]
            if not bodies:
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
            o, same = rows(bodies), False
            if first > second:
                o = {name: c[o["home"] != k] for name, c in o.items()}
        a, b = compare(q, k, same, m, o, cosine) if len(m["id"]) and len(o["id"]) else (np.zeros(0, np.int64),) * 2
        a_id, b_id = m["id"][a], o["id"][b]
        nodes, index = np.unique(np.r_[a_id, b_id], return_inverse=True)
        ia, ib = index[: len(a)], index[len(a) :]
        weight = np.bincount(ia, o["n"][b], len(nodes)) + np.bincount(ib, m["n"][a], len(nodes))
        root = common.local_roots(len(nodes), ia, ib)
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        left = np.r_[nodes[moved], nodes]
        right = pa.array(np.r_[nodes[root[moved]], np.zeros(len(nodes), np.int64)], pa.int64(), mask=np.r_[np.zeros(len(moved), bool), np.ones(len(nodes), bool)])
        return pa.table({"a": pa.array(left, pa.int64()), "b": right, "links": pa.array(np.r_[np.zeros(len(moved)), weight].astype(np.int64), pa.int64())})

    sent = distinct.mapInArrow(deal, ROWS)
    sent = sent.select("list", "i", F.when(F.col("j") < 0, -F.col("j") - 1).otherwise(F.col("j")).alias("jj"), F.when(F.col("j") < 0, 1).otherwise(0).alias("role"), "payload")
    return sent.groupBy("list", "i", "jj").applyInArrow(block_pair, SCHEMA)


def pq_neardup(table: DataFrame, cosine: float = 0.95) -> DataFrame:
    """Links of cosine >= `cosine` among embeddings: vec_id, n_links, component_id, kept.

    table: vec_id (unique), embedding; other columns are ignored. Equal vectors are folded first and count in n_links.
    The search visits each coarse list whose border a linked vector may have crossed (see DEVIATIONS), filters by
    asymmetric table look-ups with a proven error bound and reranks by the exact cosine in double precision, so no link
    below the threshold is ever given. Vectors of each length are compared among themselves. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing and keep themselves. A repeated row counts as another vector of the same
    id. An empty table gives an empty result.
    """
    rows = table.select(F.col("vec_id").cast("long"), "embedding").where("vec_id IS NOT NULL")
    good = common.checkpoint(vectors.usable(rows))
    distinct = common.checkpoint(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    found = table.sparkSession.createDataFrame([], SCHEMA)
    for rows_of_one, n in vectors.by_length(distinct):
        found = found.unionByName(links(rows_of_one, n, cosine))
    found = common.checkpoint(found)
    components = common.connected_components(found.where("b IS NOT NULL").select("a", "b"))
    weights = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    named = distinct.join(components, distinct.id == components.node, "left").join(weights, "id", "left")
    named = named.select("v", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    linked = good.join(named, "v").select("vec_id", "component", "links")
    alone = rows.select("vec_id").join(good.select("vec_id"), "vec_id", "left_anti")
    out = linked.unionByName(alone.select("vec_id", F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("links")))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
