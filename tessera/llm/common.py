"""Shared pieces: checkpoints, Arrow batches, packed payloads and connected components."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass holds; its work arrays take about 80 bytes for each.
CHUNK_BYTES = 1_500_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the cluster's spark.checkpoint.dir. Where none is set, a local master (tests) gets a folder; a cluster must name a shared one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it outlives the executors that wrote it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, which it does when the driver's JVM collects garbage."""
    spark._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in runs of few rows. Spark ends a batch at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch) or after one
    longer row, which bounds what a worker holds; no session setting is touched."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Resident bytes of a process up to which its free memory is not handed back.
HELD = 256_000_000
#: What empties each memory that a worker keeps between the tasks of one stage.
caches: list[Callable[[], None]] = []


def release() -> None:
    """Hand free memory back to the system: workers and the driver live on, and would keep the peak of every stage through all later ones.

    Memories of other stages are emptied first; a stage that uses one ends its tasks with trim().
    """
    for empty in caches:
        empty()
    trim()


def trim() -> None:
    """release() for the stage that a memory belongs to: free memory goes back, the memory stays."""
    try:
        with open("/proc/self/statm") as f:
            if int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") < HELD:
                return
    except OSError:  # not Linux
        return
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give_back:
        give_back(0)


def tidy_rows(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that ends each task with release()."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return tidied


def tidy_group(work: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A function of one or two tables for applyInArrow that ends each group with release()."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            release()

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return work(left, right)
        finally:
            release()

    return one if work.__code__.co_argcount == 1 else both


def rows_and_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows, and UTF-8 bytes of all texts; these size the buckets, so that each holds about as much at every scale."""
    r = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()
    return int(r["rows"]), int(r["n"])


def concat(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def two(head: bytes, body: bytes) -> bytes:
    """Two payloads as one."""
    return len(head).to_bytes(4, "little") + head + body


def split_two(payload: bytes) -> tuple[bytes, bytes]:
    k = 4 + int.from_bytes(payload[:4], "little")
    return payload[4:k], payload[k:]


def pack(**columns: np.ndarray) -> bytes:
    """Numeric columns of one length as one compressed payload that names its columns.

    The bytes of a column lie by their place in the number, so that the high bytes, mostly alike, compress to nothing.
    """
    n = len(next(iter(columns.values())))
    head = f"{n} " + " ".join(f"{k}{v.dtype.str}" for k, v in columns.items()) + "\n"
    planes = (np.ascontiguousarray(v).view(np.uint8).reshape(n, v.itemsize).T.tobytes() if n else b"" for v in columns.values())
    return zstandard.ZstdCompressor(level=1).compress(head.encode() + b"".join(planes))


def unpack(payload: bytes) -> dict[str, np.ndarray]:
    """The columns of pack()."""
    data = zstandard.ZstdDecompressor().decompress(payload)
    at = data.index(b"\n") + 1
    n, *kinds = data[: at - 1].decode().split(" ")
    out = {}
    for kind in kinds:
        cut = next(i for i, c in enumerate(kind) if c in "<>|")  # where the dtype starts
        kept = np.dtype(kind[cut:])
        size = int(n) * kept.itemsize
        out[kind[:cut]] = np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(kept.itemsize, int(n)).T).view(kept).ravel()
        at += size
    return out


def unpack_all(payloads) -> dict[str, np.ndarray]:
    return concat([unpack(p) for p in payloads])


def pack_texts(ids: np.ndarray, texts: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    head = len(texts).to_bytes(8, "little") + ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(texts))


def unpack_texts(payload: bytes) -> tuple[np.ndarray, list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    n = int.from_bytes(data[:8], "little")
    ids, lengths = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i8", n, 8 + 8 * n)
    ends = 8 + 16 * n + np.cumsum(lengths)
    return ids, [data[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]


def text_list(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts as bytes (null: empty) of a batch of (doc_id, text)."""
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    texts = batch.column("text").cast(pa.large_binary()).to_pylist()
    return ids, [t or b"" for t in texts]


def chunks(ids: np.ndarray, texts: list[bytes], most: int = CHUNK_BYTES):
    """Runs of whole texts of about `most` bytes together; a longer text is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield ids[at:i], texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield ids[at:], texts[at:]


def keep_rows(docs: DataFrame, keep: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows of docs, with all their columns, for whose texts (null: empty) `keep` gives True; nothing is shuffled."""

    @tidy_rows
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            masks = [keep(t) for _, t in chunks(np.arange(len(texts)), texts)]
            yield batch.filter(pa.array(np.concatenate(masks) if masks else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def runs_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.r_[starts[1:], len(sorted_values)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] ... starts[i] + lengths[i] - 1 of every i, one after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts.astype(np.int64) - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(total)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of 0 ... n - 1 over the links a - b: hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


#: Links of a node beyond which it is joined by broadcast, and the most such nodes that there can be.
HOT_LINKS, HOT_NODES = 100_000, 200_000


def to_each(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """edges (u, v) with the m of u from least (u, m, n: links of u). Nodes with very many links meet theirs by broadcast:
    of `n` links in all, each counted at both ends, at most HOT_NODES nodes can have that many."""
    hot = max(HOT_LINKS, 2 * n // HOT_NODES)
    if n <= hot:
        return edges.join(least.select("u", "m"), "u")
    of_hot = F.broadcast(least.where(F.col("n") > hot).select("u", "m"))
    cold = edges.join(of_hot, "u", "left_anti").join(least.where(F.col("n") <= hot).select("u", "m"), "u")
    return cold.unionByName(edges.join(of_hot, "u"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) links to (node, component): the smallest node reachable, by alternating large and small stars.

    Each round is one groupBy-min and one join keyed by node and is checkpointed; rounds grow with the logarithm of
    the longest path. Nodes without links do not occur. Null ends and self links are dropped.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last = checkpoint(e), None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        n = now["n"]
        if not n or now == last:
            break
        last = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        big = to_each(e.select(F.col("v").alias("u"), F.col("u").alias("v")), low, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # each node's own smaller neighbours, all hung on the smallest of them
        least = big.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = to_each(big, least, n)
        e = checkpoint(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
