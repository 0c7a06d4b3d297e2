"""Toxicity: cumulative-link ordinal regression from sparse text features to an expected severity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, features
from tessera.llm.ftrl import Ftrl
from tessera.llm.quality import labelled, passes

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
#: Updates that a small sample is repeated for.
UPDATES = 36_000
#: A text whose chance of any severity is at least this is toxic.
THRESHOLD = 0.4
#: A marker is a slot whose smoothed log-odds for toxic rows are at least this; so many of them make a severe row.
MARKER, SEVERE = 3.5, 3
#: Lengths of word beginnings (bytes) that are features beside whole words.
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Ordinal:
    """One weight vector for all grades, and ascending thresholds between them."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) for each threshold k; their sum is the expected severity."""
        slot, value, ends = features.sparse([t.lower() for t in texts], 1, presence=True, prefixes=PREFIXES)
        s = features.dots(self.weights, slot, value, ends)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(s[:, None] - self.thresholds[None, :])))


def grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Severity grades from a yes-or-no label: 0 clean, 1 toxic, 2 toxic with SEVERE or more different marker words."""
    size = 1 << features.BITS
    counts = [np.bincount(np.concatenate([r for r, t in zip(rows, toxic, strict=True) if (t > 0) == kind] or [np.zeros(0, np.int64)]), minlength=size) for kind in (False, True)]
    totals = [max(1, int((toxic > 0).sum() if kind else (toxic <= 0).sum())) for kind in (False, True)]
    odds = np.log((counts[1] + 0.5) / (totals[1] + 1)) - np.log((counts[0] + 0.5) / (totals[0] + 1))
    marker = (odds >= MARKER) & (counts[1] >= 10)
    return np.array([0 if t <= 0 else 1 + (marker[r].sum() >= SEVERE) for r, t in zip(rows, toxic, strict=True)], np.int64)


def fit(texts: list[bytes], toxic: np.ndarray, epochs: int | None = None, alpha: float = 1.0, l1: float = 3.0, l2: float = 0.1) -> Ordinal:
    """Row by row: the shared weights by FTRL, the thresholds by their own, kept in order. No rows: nothing is toxic."""
    size = 1 << features.BITS
    rows = []
    for at in range(0, len(texts), 500):
        slot, _, ends = features.sparse([t.lower() for t in texts[at : at + 500]], 1, presence=True, prefixes=PREFIXES)
        rows += np.split(slot, ends[:-1]) if len(ends) else []
    y = grades(rows, toxic)
    levels = 2
    model, gap = Ftrl(size, alpha, 1.0, l1, l2), np.array([2.0, 4.0])
    moved = np.full(levels, 1e-6)
    for _ in range(epochs or passes(len(rows), UPDATES, 3)):
        for at, grade in zip(rows, y.tolist(), strict=True):
            w = model.weights(at)
            s = w.sum()
            edge = 1 / (1 + np.exp(-np.clip(gap - s, -30, 30)))  # P(grade <= k)
            upper = edge[grade] if grade < levels else 1.0
            lower = edge[grade - 1] if grade else 0.0
            mass = max(upper - lower, 1e-9)
            model.update(at, w, np.full(len(at), 1 - upper - lower))
            step = np.zeros(levels)
            if grade < levels:
                step[grade] -= upper * (1 - upper) / mass
            if grade:
                step[grade - 1] += lower * (1 - lower) / mass
            moved += step * step
            gap = np.maximum.accumulate(gap - 0.3 * step / (1 + np.sqrt(moved)) + np.array([0, 1e-9]))
    return Ordinal(model.weights().astype(np.float32), gap)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", most: int = SAMPLE) -> Ordinal:
    model = fit(*labelled(docs, labels, F.col(column), most))
    common.release()  # the driver goes on without the texts
    return model


def score_toxicity(docs: DataFrame, model: Ordinal, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, severity (0 to 2, expected grade), grade (likeliest), toxic of every row with a doc_id, by its whole text."""
    @common.tidy_rows
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            ids, texts = common.text_list(batch)
            above = [model.above(t) for _, t in common.chunks(ids, texts)]
            p = np.concatenate(above) if above else np.zeros((0, 2))
            each = np.c_[1 - p[:, 0], p[:, 0] - p[:, 1], p[:, 1]]
            columns = [pa.array(ids, pa.int64()), pa.array(p.sum(axis=1)), pa.array(each.argmax(axis=1), pa.int32()), pa.array(p[:, 0] >= threshold)]
            yield pa.record_batch(columns, names=["doc_id", "severity", "grade", "toxic"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    return docs.mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Expected severity of every document.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1; graded by grades()); other columns are ignored. Learns from rows
    that are not held out (as the quality classifier). A null or empty text has no features and counts as clean;
    without labels nothing is toxic. Repeated rows are scored alike.
    """
    return score_toxicity(docs, train(docs, labels), threshold)
