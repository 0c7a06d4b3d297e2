"""Vectors of stored summaries and chunks, made where they are missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import retrieval, vector
from tessera.sources import shared
from tessera.sources.store import Store


@dataclass
class Embedded:
    """What a run added, and the length of its vectors (None if it added none)."""

    summaries: int = 0
    chunks: int = 0
    dimension: int | None = None


def missing(store: Store, rows: str, vectors: str, text: str, files: DataFrame | None = None) -> DataFrame:
    """(id, text) of the stored rows that have no vector, of all files or of those of `files` (file_id)."""
    held = store.read(rows) if files is None else store.read(rows).join(files.select("file_id"), "file_id", "left_semi")
    return held.join(store.read(vectors).select("id"), "id", "left_anti").select("id", F.col(text).alias("text"))


def embed_store(store: Store, embedder: vector.Embedder, files: DataFrame | None = None) -> Embedded:
    """Adds the vectors of summaries and chunks that have none, in one commit. files (file_id): only those of these files.

    Every text is embedded once; vectors of rows that are gone were removed with them.
    """
    out, made = Embedded(), {}
    for rows, vectors, text in (("summaries", "summary_embeddings", "summary"), ("code_chunks", "code_embeddings", "content")):
        made[vectors] = shared.checkpoint(vector.embed_texts(missing(store, rows, vectors, text, files), embedder))
    out.summaries, out.chunks = made["summary_embeddings"].count(), made["code_embeddings"].count()
    if out.summaries or out.chunks:
        with store.transaction() as t:
            for vectors, rows in made.items():
                t.append(vectors, rows)
        first = made["summary_embeddings"].unionByName(made["code_embeddings"]).first()
        out.dimension = len(first["embedding"])
    return out


def changed_vectors(store: Store, changed: DataFrame, embedder: vector.Embedder) -> DataFrame:
    """(id, kind, embedding) of the changed files (id), from the file's summary and from its chunks; what a file lacks it has no vector of."""
    ours = changed.select(F.col("id").alias("file_id"))
    told = store.read("summaries").where("level = 'file'").join(ours, "file_id", "left_semi").groupBy(F.col("file_id").alias("id")).agg(F.min("summary").alias("text"))
    code = retrieval.chunk_text(store.read("code_chunks").join(ours, "file_id", "left_semi")).withColumnRenamed("file_id", "id")
    kinds = [vector.embed_texts(rows, embedder).withColumn("kind", F.lit(kind)) for kind, rows in (("summary", told), ("code", code))]
    return shared.checkpoint(kinds[0].unionByName(kinds[1]).select("id", "kind", "embedding"))  # one change's files


def stored_vectors(store: Store) -> tuple[DataFrame, DataFrame]:
    """(id, file_id, embedding) of the summaries (null for those of symbols) and of the chunks."""
    summaries = store.read("summary_embeddings").join(store.read("summaries").select("id", "file_id"), "id")
    return summaries, store.read("code_embeddings").join(store.read("code_chunks").select("id", "file_id"), "id")
