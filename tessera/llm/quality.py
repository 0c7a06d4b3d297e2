"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, features
from tessera.llm.ftrl import Ftrl

#: Labelled rows that the model is fitted on, at most, by the order of a hash of doc_id.
SAMPLE = 6000
#: Updates that a small sample is repeated for.
UPDATES = 12_000
#: Bytes of text that a model is fitted on, at most; rows that do not fit are left out.
TRAINING_BYTES = 64_000_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Logistic:
    """Weights of 2**bits slots (a megabyte, whatever the corpus), and a bias."""

    weights: np.ndarray
    bias: float
    ngrams: int

    def score(self, texts: list[bytes]) -> np.ndarray:
        slot, value, ends = features.sparse(texts, self.ngrams)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(features.dots(self.weights, slot, value, ends) + self.bias)))


def fit(texts: list[bytes], labels: np.ndarray, ngrams: int = 2, epochs: int | None = None, alpha: float = 1.0, l1: float = 0.1, l2: float = 0.1) -> Logistic:
    """Row by row in the order given; no row gives a model that always answers one half.

    epochs: passes over the rows; by default so many that about UPDATES are made, 2 to 20.
    """
    size = 1 << features.BITS
    model = Ftrl(size + 1, alpha, 1.0, l1, l2)
    rows = []
    for at in range(0, len(texts), 500):
        slot, value, ends = features.sparse(texts[at : at + 500], ngrams)
        starts = np.r_[0, ends[:-1]]
        rows += [(np.r_[slot[a:b], size], np.r_[value[a:b], np.float32(1)]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    for _ in range(epochs or passes(len(rows), UPDATES, 2)):
        for (at, x), y in zip(rows, labels.tolist(), strict=True):
            w = model.weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            model.update(at, w, (p - y) * x)
    w = model.weights()
    return Logistic(w[:size].astype(np.float32), float(w[size]), ngrams)


def passes(rows: int, updates: int, least: int) -> int:
    return min(20, max(least, -(-updates // max(rows, 1))))


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, label: F.Column, most: int = SAMPLE, size: int = TRAINING_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Whole texts and labels of at most `most` rows and `size` bytes that are not held out, in the order of a hash of doc_id.

    A row that does not fit into the bytes left is passed over, later ones still count. Rows that are the same in doc_id, label
    and text count once. The lengths of `most` rows reach the driver first, then the texts of those taken.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    labels = labels.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(labels), "doc_id").withColumns({"tie": F.xxhash64("text"), "n": F.coalesce(F.octet_length("text"), F.lit(0))})  # the labels are bounded by `most`
    first = rows.select("doc_id", "label", "tie", "n").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label", "tie").limit(most).collect()
    taken, used = [], 0
    for r in first:
        if used + r["n"] <= size:
            taken.append((r["doc_id"], r["label"], r["tie"]))
            used += r["n"]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long, label int, tie long"))
    rows = rows.drop("n").join(chosen, ["doc_id", "label", "tie"]).dropDuplicates(["doc_id", "label", "tie"]).toArrow()
    order = np.lexsort((rows.column("tie").to_numpy(), rows.column("label").to_numpy(), rows.column("doc_id").to_numpy() * 2654435761 % 2**31))
    held = rows.column("text").cast(pa.large_binary()).take(pa.array(order)).to_pylist()
    values = rows.column("label").to_numpy()[order]
    del rows
    pa.default_memory_pool().release_unused()  # the driver goes on without the Arrow copy of the texts
    return [t or b"" for t in held], values


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = SAMPLE) -> Logistic:
    model = fit(*labelled(docs, labels, F.col(column), most))
    common.release()  # the driver goes on without the texts
    return model


def score_quality(docs: DataFrame, model: Logistic) -> DataFrame:
    """(doc_id, score): the model's probability that a whole text is good, by sparse dot products. Null counts as empty."""
    @common.tidy_rows
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            ids, texts = common.text_list(batch)
            scores = [model.score(t) for _, t in common.chunks(ids, texts)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    return docs.mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs with a doc_id.

    docs: doc_id, text; labels: doc_id, quality (1 good, 0 bad); other columns are ignored, and no label is an input of
    a score. Null labels are not learnt from; without labels every score is one half. An empty text is scored by the
    bias alone. Repeated rows are scored alike.
    """
    scored = score_quality(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
