"""A corpus pipeline of five stages over `documents`: from raw texts to packed training sequences."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, packing, quality, queries, simhash, substring_dedup, toxicity

#: Words of a shingle, the Jaccard similarity of near-duplicates, bits of a fingerprint, and the distance that fingerprints meet at for certain.
SHINGLE, SIMILARITY, BITS, SURE = 5, 0.8, 256, 20

#: No stage's rows can be given by SQL.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def few_rows(stage: Stage) -> Stage:
    """Arrow batches of 1000 rows while a stage runs its jobs, so that an executor of 3 GB holds few texts at once; the session's own setting comes back."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        option = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = spark.conf.get(option)
        spark.conf.set(option, "1000")
        try:
            return stage(spark, docs, sf_dir)
        finally:
            spark.conf.set(option, before)

    return run


@few_rows
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not call toxic.

    Every row is judged by itself and keeps all its columns: repeated rows, rows without a doc_id, null, empty (both clean) and
    very long texts; no labels: all rows stay; an empty table gives an empty one.
    """
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    return common.keep_rows(docs, lambda texts: model.above(texts)[:, 0] < toxicity.THRESHOLD)


@few_rows
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; rows as in drop_toxic(). A null or empty text has the bias as its score."""
    model = quality.train(docs, queries.table(spark, sf_dir, "labels"))
    return common.keep_rows(docs, lambda texts: model.score(texts) >= quality.THRESHOLD)


@few_rows
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest doc_id.

    Rows without a doc_id stay; repeated rows of a doc_id stay or go together. Null and empty texts are equal to each
    other; of different texts of one doc_id the least is compared. An empty table gives an empty one.
    """
    found = simhash.jaccard_neardup(docs, SHINGLE, SIMILARITY, BITS, SURE)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


@few_rows
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeat an earlier passage; n_chars follows.

    Every row stays: repeated rows of a doc_id each once, and rows without a doc_id with their whole text.
    """
    kept = substring_dedup.substring_dedup(docs, digests=True).select("doc_id", "text_sha256", "kept").dropDuplicates(["doc_id", "text_sha256"])
    # the row travels as one value, so no column of it can meet a column of the operator
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.sha2(F.coalesce(docs["text"], F.lit("")), 256).alias("digest"))
    met = (rows["row"]["doc_id"] == kept["doc_id"]) & (rows["digest"] == kept["text_sha256"])
    out = rows.join(kept, met, "left").select("row", F.when(F.col("row")["doc_id"].isNull(), F.col("row")["text"]).otherwise(kept["kept"]).alias("new"))
    new = {"text": F.col("new"), "n_chars": F.char_length("new").cast("long")}
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


@few_rows
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of 2048. Rows without a doc_id go; a repeated row is packed again; a null or empty
    text is the end mark alone; an empty table gives no pieces."""
    return packing.pack_documents(docs, queries.tokenizer_file("word_bpe_49k.json"), tokens=False, together=4_000_000, remembered=120_000_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("simhash_neardup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each one's result is checkpointed for the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.checkpoint(docs)
    return docs
