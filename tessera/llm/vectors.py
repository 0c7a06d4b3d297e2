"""What the two vector operators share: valid rows, bounded samples, k-means and block layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that centroids and codebooks are fitted on, at most; every row is indexed.
SAMPLE = 20_000


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): little-endian doubles of the vectors that are not null, not empty, not zero and hold finite numbers only.

    Vectors of every length stay; their operators compare those of one length with each other, as no cosine is defined
    between two lengths.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id IS NOT NULL AND size(embedding) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("vec_id").to_numpy(), batch.column("embedding")
            lengths = column.value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                own = lengths == dim
                x = column.filter(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("<f8")
                with np.errstate(over="ignore", invalid="ignore"):
                    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                yield pa.record_batch([pa.array(ids[own][good], pa.int64()), pa.array([r.tobytes() for r in x[good]], pa.binary())], names=["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v binary")


def by_length(rows: DataFrame, least: int = 2) -> list[tuple[DataFrame, int]]:
    """rows (v, ...) of each length of v that at least `least` rows have, with their count, shortest first."""
    counts = rows.groupBy(F.octet_length("v").alias("bytes")).count().where(F.col("count") >= least).orderBy("bytes").collect()  # a handful of models
    return [(rows.where(F.octet_length("v") == r["bytes"]), r["count"]) for r in counts]


def matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1) if values else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sample(vectors: DataFrame, key: str) -> np.ndarray:
    """Unit rows of a hash-ordered sample of at most SAMPLE vectors."""
    got = vectors.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("v").toArrow().column("v")
    return unit(matrix(got)) if len(got) else np.zeros((0, 1))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (((centres * centres).sum(axis=1) - 2 * (x @ centres.T))).argmin(axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """At most k centres; an empty centre keeps its place."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(count)
        centres[filled] = np.add.reduceat(x[order], np.r_[0, np.cumsum(count[filled])[:-1]], axis=0) / count[filled, None]
    return centres


def cuts(dim: int, parts: int) -> list[slice]:
    """The dimensions in `parts` (or fewer) runs of about equal length."""
    return [slice(int(a[0]), int(a[-1]) + 1) for a in np.array_split(np.arange(dim), min(parts, dim))]
