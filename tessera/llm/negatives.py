"""Hard-negative mining over a vector-approximation file: cell bounds by table look-up, exact scores only where they can matter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common, vectors

#: Rows for each coarse list, most lists of one length, rows of a tile, anchors of a tile.
PER_LIST, MOST_LISTS, BLOCK, TILE = 8000, 1024, 8192, 8192
#: Cells that a tile cuts each dimension into; two dimensions share one table of CELLS ** 2 entries.
CELLS = 16
#: Squared length of integer vectors below which every inner product fits a long, and that up to which doubles add them exactly.
FITS, EXACT = 2.0**62, 2.0**53

KEY = "dim int, list int, block int, part int"
FOUND = "anchor_id long, vec_id long, score long"
MINED = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def cells_of(table: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, c): the components as floor(scale * x), little-endian longs, of the rows that take part, one for each vec_id."""
    rows = table.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, column = batch.column("vec_id"), batch.column("label"), batch.column("embedding")
            lengths = column.value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                own = lengths == dim
                x = column.filter(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(int(own.sum()), dim).astype("<f8")
                with np.errstate(over="ignore", invalid="ignore"):
                    c = np.floor(scale * x)
                    good = np.isfinite(x).all(axis=1) & ((c * c).sum(axis=1) < FITS)
                at = pa.array(np.flatnonzero(own)[good])
                yield pa.record_batch([ids.take(at), labels.take(at), pa.array([r.tobytes() for r in c[good].astype("<i8")], pa.binary())], names=["vec_id", "label", "c"])

    return rows.mapInArrow(run, "vec_id long, label long, c binary").groupBy("vec_id").agg(F.min(F.struct("label", "c")).alias("least")).select("vec_id", "least.label", "least.c")


def integers(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<i8").reshape(len(values), -1) if values and values[0] else np.zeros((len(values), 0), np.int64)


class Approximation:
    """The cells of a tile's rows and, for an anchor, bounds of all their inner products by table look-up.

    A cell is a run of whole numbers of one dimension. A pair of dimensions is one code; its table holds the least and
    the largest that the two components can add to the product, as real and imaginary part of one number, so that one
    look-up and one addition serve both bounds.
    """

    def __init__(self, c: np.ndarray):
        n, dim = c.shape
        low, high = (c.min(axis=0), c.max(axis=0)) if n and dim else (np.zeros(dim, np.int64),) * 2
        width = (high - low) // CELLS + 1
        codes = (c - low) // width
        self.low = low + np.arange(CELLS)[:, None] * width  # (CELLS, dim)
        self.high = np.minimum(self.low + width - 1, np.maximum(high, self.low))
        if dim % 2:
            codes = np.c_[codes, np.zeros(n, np.int64)]
            self.low, self.high = (np.c_[b, np.zeros(CELLS, np.int64)] for b in (self.low, self.high))
        self.codes = np.ascontiguousarray((codes[:, ::2] * CELLS + codes[:, 1::2]).T.astype(np.intp))
        self.c = c.astype(np.float64) if not c.size or float((c.astype(np.float64) ** 2).sum(axis=1).max()) < EXACT else c

    def bounds(self, q: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of q with these rows."""
        q = np.r_[q, 0][: self.low.shape[1]].astype(np.float64)
        a, b = self.low * q, self.high * q
        single = (np.minimum(a, b) + 1j * np.maximum(a, b)).T.reshape(-1, 2, CELLS)
        tables = (single[:, 0, :, None] + single[:, 1, None, :]).reshape(-1, CELLS * CELLS)
        codes = self.codes[:, rows]
        total, one = np.zeros(codes.shape[1], np.complex128), np.empty(codes.shape[1], np.complex128)
        for table, code in zip(tables, codes, strict=True):
            total += np.take(table, code, out=one, mode="clip")
        spread = 1e-12 * float(np.abs(single).max(initial=0)) * len(q)  # rounding, where numbers pass 2**53
        return (total.real, total.imag) if spread < 1e-3 else (total.real - spread, total.imag + spread)

    def exact(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        c = self.c[at]
        fits = c.dtype == np.float64 and float((q.astype(np.float64) ** 2).sum()) < EXACT
        return (c @ q.astype(c.dtype)).astype(np.int64) if fits else c.astype(np.int64) @ q


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest; minus infinity if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def first(ids: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int]]:
    top = np.lexsort((ids, -score))[:k]
    return list(zip(ids[top].tolist(), score[top].tolist(), strict=True))


def positives(tile: Approximation, ids: np.ndarray, rows: slice, anchor: int, q: np.ndarray, least: float, k: int) -> list[tuple[int, int]]:
    """The k best of the rows (those of the anchor's label), the anchor itself left out, that can reach `least`."""
    low, high = tile.bounds(q, rows)
    own = ids[rows] == anchor
    low, high = np.where(own, -np.inf, low), np.where(own, -np.inf, high)
    at = np.flatnonzero((high >= max(least, kth(low, k))) & ~own) + rows.start
    return first(ids[at], tile.exact(q, at), k)


def negatives(tile: Approximation, ids: np.ndarray, rows: slice, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each window (least, most) the k best of the rows whose product lies in it."""
    low, high = tile.bounds(q, rows)
    near = np.flatnonzero((high >= min(w for w, _ in windows)) & (low <= max(w for _, w in windows)))
    low, high = low[near], high[near]
    masks = []
    for least, most in windows:
        sure = kth(low[(low >= least) & (high <= most)], k)
        masks.append((high >= max(least, sure)) & (low <= most))
    at = np.flatnonzero(np.logical_or.reduce(masks)) if masks else np.zeros(0, np.int64)
    score = tile.exact(q, near[at] + rows.start)
    out = []
    for least, most in windows:
        fits = (score >= least) & (score <= most)
        out.append(first(ids[near[at[fits]] + rows.start], score[fits], k))
    return out


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores n with low * positive <= 100 * n <= high * positive."""
    return -((-low * positive) // 100), high * positive // 100


class Lists:
    """Coarse lists of the vectors of each length: centres from a bounded sample, radius and size from all rows.

    A product q.v with a row v of a list lies within |q| * radius of q.centre, which tells the lists that an anchor can skip.
    """

    def __init__(self, rows: DataFrame):
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(vectors.SAMPLE).select("c").toArrow().column("c").to_pylist()
        count = {r["dim"]: r["n"] for r in rows.groupBy((F.octet_length("c") / 8).cast("int").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row for each length
        self.centres = {}
        for dim, n in count.items():
            x = integers([c for c in sample if len(c) == 8 * dim]).astype(np.float64)
            lists = int(np.clip(n // PER_LIST, 1, min(MOST_LISTS, max(1, len(x) // 16))))
            self.centres[dim] = vectors.kmeans(x, lists) if lists > 1 else np.zeros((1, dim))
        centres = self.centres

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, c, _ in by_dim(batch):
                    own = vectors.nearest(c, centres[dim])
                    far = np.sqrt(((c - centres[dim][own]) ** 2).sum(axis=1))
                    lists, at = np.unique(own, return_inverse=True)
                    radius = np.zeros(len(lists))
                    np.maximum.at(radius, at, far)
                    yield pa.record_batch([pa.array([dim] * len(lists), pa.int32()), pa.array(lists, pa.int32()), pa.array(np.bincount(at)), pa.array(radius)], names=["dim", "list", "n", "radius"])

        self.size = {d: np.zeros(len(c), np.int64) for d, c in centres.items()}
        self.radius = {d: np.full(len(c), -np.inf) for d, c in centres.items()}
        for r in rows.mapInArrow(measure, "dim int, list int, n long, radius double").groupBy("dim", "list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect():
            self.size[r["dim"]][r["list"]], self.radius[r["dim"]][r["list"]] = r["n"], r["radius"] * (1 + 1e-9) + 1e-6

    def blocks(self, dim: int) -> np.ndarray:
        return -(-self.size[dim] // BLOCK)

    def reach(self, dim: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (anchors, lists) of the products of the anchors q with any row of each list."""
        middle, length = q @ self.centres[dim].T, np.sqrt((q * q).sum(axis=1))[:, None]
        spread = length * np.maximum(self.radius[dim], 0)[None, :] * (1 + 1e-9)
        filled = self.size[dim] > 0
        return np.where(filled, middle - spread, np.inf), np.where(filled, middle + spread, -np.inf)


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, vectors as doubles and row numbers of the rows of each length."""
    values = batch.column("c").to_pylist()
    lengths = np.fromiter((len(v) // 8 for v in values), np.int64, len(values))
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield dim, integers([values[i] for i in at]).astype(np.float64), at


def spread(ids: np.ndarray, over) -> np.ndarray:
    """A number below `over` for each id, by the high bits of a product."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % over


def keyed(keys: list[tuple[int, int, int, int]], batch: pa.RecordBatch, at: list[int]) -> pa.RecordBatch:
    columns = list(zip(*keys, strict=True)) if keys else [()] * 4
    names = ["dim", "list", "block", "part"]
    return pa.record_batch([*(pa.array(c, pa.int32()) for c in columns), *batch.take(pa.array(at, pa.int64())).columns], names=[*names, *batch.schema.names])


def deal_rows(rows: DataFrame, lists: Lists, parts: int) -> DataFrame:
    """KEY and the row: its list, its block in it, once for each part of the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 4096):
            ids = batch.column("vec_id").to_numpy()
            keys, rows_at = [], []
            for dim, c, at in by_dim(batch):
                own = vectors.nearest(c, lists.centres[dim])
                block = spread(ids[at], lists.blocks(dim)[own])
                keys += [(dim, a, b, p) for a, b in zip(own.tolist(), block.tolist(), strict=True) for p in range(parts)]
                rows_at += np.repeat(at, parts).tolist()
            yield keyed(keys, batch, rows_at)

    return rows.mapInArrow(run, f"{KEY}, vec_id long, label long, c binary")


def deal_anchors(anchors: DataFrame, lists: Lists, parts: int, visits: Callable[[int, np.ndarray, pa.RecordBatch, np.ndarray], np.ndarray], schema: str) -> DataFrame:
    """KEY and the anchor, for every block of the lists that visits() names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1000):
            part = spread(batch.column("vec_id").to_numpy(), parts)
            keys, rows_at = [], []
            for dim, c, at in by_dim(batch):
                blocks = lists.blocks(dim)
                for row, each in zip(*np.nonzero(visits(dim, c, batch, at)), strict=True):
                    keys += [(dim, int(each), b, int(part[at[row]])) for b in range(int(blocks[each]))]
                    rows_at += [int(at[row])] * int(blocks[each])
            yield keyed(keys, batch, rows_at)

    return anchors.mapInArrow(run, f"{KEY}, {schema}")


class Tile:
    """The rows of one group, ordered by label, and their approximation."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("label", "ascending"), ("vec_id", "ascending")])
        self.ids, self.labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        self.approximation = Approximation(integers(rows.column("c").to_pylist()))

    def same(self, label: int) -> slice:
        return slice(*(int(np.searchsorted(self.labels, label, side)) for side in ("left", "right")))

    def others(self, label: int) -> list[slice]:
        same = self.same(label)
        return [s for s in (slice(0, same.start), slice(same.stop, len(self.ids))) if s.stop > s.start]


def result(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


def best_positives(tiles: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """FOUND rows: the k best of each tile."""

    @common.tidy_group
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            tile = Tile(rows)
            for anchor, label, q, least in zip(anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist(), integers(anchors.column("c").to_pylist()), anchors.column("least").to_pylist(), strict=True):
                same = tile.same(label)
                if same.stop > same.start:
                    found += [(anchor, i, s) for i, s in positives(tile.approximation, tile.ids, same, anchor, q, -np.inf if least is None else least, k)]
        return result(found, ["anchor_id", "vec_id", "score"])

    keys = ["dim", "list", "block", "part"]
    return tiles.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, FOUND)


def best_negatives(tiles: DataFrame, asked: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """MINED rows: the k best of each tile within the window of each positive."""

    @common.tidy_group
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            tile = Tile(rows)
            for anchor, label, q, pairs in zip(anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist(), integers(anchors.column("c").to_pylist()), anchors.column("positives").to_pylist(), strict=True):
                windows = [window(p["score"], low, high) for p in pairs]
                for part in tile.others(label):
                    for p, some in zip(pairs, negatives(tile.approximation, tile.ids, part, q, windows, k), strict=True):
                        found += [(anchor, p["vec_id"], p["score"], i, s) for i, s in some]
        return result(found, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    keys = ["dim", "list", "block", "part"]
    return tiles.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, MINED)


def hard_negatives(table: DataFrame, every: int = 50, k_positive: int = 5, k_negative: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """For each anchor (a row whose vec_id is divisible by `every`) and each of its `k_positive` best rows of the same label, the
    `k_negative` best rows of other labels whose score lies between low and high per cent of the positive's.

    table: vec_id, label, embedding; other columns are ignored. The score of a row is the inner product of the integer
    vectors floor(scale * x), exact; higher ones come first, ties to the smaller vec_id. Returns anchor_id, positive_id,
    rank (from 1), negative_id, positive_score, negative_score; all results are exact.

    Rows are held in coarse lists of blocks; an anchor visits the lists that its bounds don't rule out, first its own,
    whose k-th score then rules out others, then the rest. In a block each dimension is cut into cells, the bounds of
    all products are looked up, and only rows that can be among the best, or within a window, are scored.

    Rows with a null vec_id, label or vector, with null or non-finite components, or so long (2**31) that scores leave a long
    take no part. Vectors of different lengths are not compared; empty ones (length 0) have score 0 with each other. Of
    rows that repeat a vec_id the one with the least label counts, then the one whose numbers come first as bytes. A zero or negative positive score has a window of 0 or none.
    Fewer positives or negatives give fewer rows; an empty table gives none.
    """
    rows = common.checkpoint(cells_of(table, scale))
    lists = Lists(rows)
    anchors = rows.where(F.col("vec_id") % every == 0)
    parts = max(1, -(-anchors.count() // TILE))
    dealt = deal_rows(rows, lists, parts)
    base = "vec_id long, label long, c binary"

    def home(dim: int, c: np.ndarray, batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(c), len(lists.centres[dim])), bool)
        out[np.arange(len(c)), vectors.nearest(c, lists.centres[dim])] = True
        return out

    def away(dim: int, c: np.ndarray, batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
        least = np.array([-np.inf if v is None else v for v in batch.column("least").take(pa.array(at)).to_pylist()])
        return (lists.reach(dim, c)[1] >= least[:, None]) & ~home(dim, c, batch, at)

    def in_window(dim: int, c: np.ndarray, batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
        scores = [[p["score"] for p in v] for v in batch.column("positives").take(pa.array(at)).to_pylist()]
        spans = [[w for w in (window(s, low, high) for s in one) if w[0] <= w[1]] for one in scores]
        least = np.array([min((w for w, _ in one), default=np.inf) for one in spans], np.float64)
        most = np.array([max((w for _, w in one), default=-np.inf) for one in spans], np.float64)
        below, above = lists.reach(dim, c)
        return (above >= least[:, None]) & (below <= most[:, None])

    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_positive).select("anchor_id", "vec_id", "score")

    near = common.checkpoint(best(best_positives(dealt, deal_anchors(anchors.withColumn("least", F.lit(None).cast("double")), lists, parts, home, f"{base}, least double"), k_positive)))
    if any(len(c) > 1 for c in lists.centres.values()):
        floor = near.groupBy("anchor_id").agg(F.when(F.count("*") >= k_positive, F.min("score").cast("double")).alias("least"))
        ask = anchors.join(floor, anchors["vec_id"] == floor["anchor_id"], "left").select("vec_id", "label", "c", "least")
        near = common.checkpoint(best(near.unionByName(best_positives(dealt, deal_anchors(ask, lists, parts, away, f"{base}, least double"), k_positive))))
    held = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("vec_id", "score"))).alias("positives"))  # k_positive at most
    ask = anchors.join(held, anchors["vec_id"] == held["anchor_id"]).select("vec_id", "label", "c", "positives")
    mined = best_negatives(dealt, deal_anchors(ask, lists, parts, in_window, f"{base}, positives array<struct<vec_id:long,score:long>>"), k_negative, low, high)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_negative).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
