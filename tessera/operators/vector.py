"""Exact nearest neighbours by Euclidean distance, and embedding of what has none yet."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed

#: Most bytes of query vectors that are broadcast; more queries go block by block.
QUERY_BYTES = 64_000_000


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def rows_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column hold `dim` numbers and no null, and their matrix."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = lengths == dim
    if column.flatten().null_count:
        good &= np.array([v is not None and None not in v for v in column.to_pylist()], bool)
    return good, column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest_rows(rough: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of what can be among the k least of each row and below its bound, with all within rounding error of the k-th."""
    take = min(k, rough.shape[1])
    edge = np.minimum(np.partition(rough, take - 1, axis=1)[:, take - 1], bound)
    return np.nonzero(rough <= (edge + 1e-7 * (1 + np.abs(edge)))[:, None])


def knn(queries: DataFrame, base: DataFrame, k: int = fixed.KNN_K) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of base (id, embedding) for each query (query_id, embedding).

    Every stored row competes; ties go to the smaller id. The query side is collected, in parts of a checked size
    (QUERY_BYTES), and each part scans base with one matrix product per Arrow batch; a task keeps the k best of all its
    batches, so what is shuffled is bounded by queries * k * tasks. Null vectors, nulls in them and other lengths take no part.
    """
    spark = base.sparkSession
    asked = queries.where("embedding IS NOT NULL").select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
    sizes = asked.groupBy(F.size("embedding").alias("dim")).count().collect()
    rows = base.where("embedding IS NOT NULL").select(F.col("id").cast("long"), "embedding")

    def scan(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        dim = q.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = np.full((len(q), k), np.inf)
            whose = np.full((len(q), k), np.iinfo(np.int64).max)
            for batch in batches:
                good, x = rows_of(batch.column("embedding"), dim)
                if not len(x):
                    continue
                names, squares = batch.column("id").to_numpy()[good], (x * x).sum(axis=1)
                for at in range(0, len(q), 256):
                    part = q[at : at + 256]
                    rough = (part * part).sum(axis=1)[:, None] - 2 * part @ x.T + squares[None, :]
                    qi, xi = nearest_rows(rough, near[at : at + 256, -1] ** 2, k)
                    exact = np.sqrt(((part[qi] - x[xi]) ** 2).sum(axis=1))
                    # with what was kept before
                    qi = np.r_[qi, np.repeat(np.arange(len(part)), k)]
                    exact, found = np.r_[exact, near[at : at + 256].ravel()], np.r_[names[xi], whose[at : at + 256].ravel()]
                    order = np.lexsort((found, exact, qi))
                    qi, exact, found = qi[order], exact[order], found[order]
                    keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
                    near[at : at + 256], whose[at : at + 256] = exact[keep].reshape(-1, k), found[keep].reshape(-1, k)
            held = np.isfinite(near)
            row = np.nonzero(held)[0]
            yield pa.record_batch([pa.array(ids[row]), pa.array(whose[held]), pa.array(near[held])], names=["query_id", "id", "distance"])

        return rows.mapInArrow(run, "query_id long, id long, distance double")

    out = None
    for r in sizes:
        parts = -(-r["count"] * max(r["dim"], 1) * 8 // QUERY_BYTES)
        for p in range(parts):
            own = asked.where(F.size("embedding") == r["dim"])
            held = (own.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) if parts > 1 else own).toArrow().combine_chunks()
            if not r["dim"] or not held.num_rows:
                continue
            good, q = rows_of(held.column("embedding").combine_chunks(), r["dim"])
            if len(q):
                part = scan(held.column("query_id").to_numpy()[good], q)
                out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, distance double, rank int")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_details(hits: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Hits of knn() with columns of the rows (id, ...) that were hit."""
    return hits.join(rows.select("id", *columns), "id").select("query_id", "id", "distance", "rank", *columns)


def min_per_group(hits: DataFrame, group: str, by: str = "query_id") -> DataFrame:
    """The smallest distance of each group for each query."""
    return hits.groupBy(by, group).agg(F.min("distance").alias("distance"))


def within_candidates(queries: DataFrame, base: DataFrame, allowed: DataFrame, k: int, over: int = 5) -> DataFrame:
    """k * over nearest first, then only rows that match `allowed` (id, or query_id and id), then the first k."""
    hits = knn(queries, base, k * over).join(allowed, allowed.columns, "left_semi")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Embedder(Protocol):
    """What turns texts into vectors; a worker makes one from a factory and keeps it."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """A deterministic test double, not a language model: hashed words at length one."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1 if h >> 63 else -1
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).tolist())
        return out


def embed_texts(rows: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """(id, embedding) of (id, text), in batches, one embedder for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": embedder.embed(part["text"].fillna("").tolist())})

    return rows.select(F.col("id").cast("long"), "text").mapInPandas(run, "id long, embedding array<float>")


def unembedded(rows: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Rows (id ...) that have no embedding yet, by id."""
    return rows.join(embeddings.select("id"), "id", "left_anti").orderBy("id")


def embed_missing(rows: DataFrame, embeddings: DataFrame, embedder: Embedder) -> DataFrame:
    """The embedding table with what was missing added."""
    return embeddings.unionByName(embed_texts(rows.join(embeddings.select("id"), "id", "left_anti"), embedder))
