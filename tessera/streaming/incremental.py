"""Extensions beyond batch: the history as a stream, and chunk tables kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunks
from tessera.sources.files import RECORD


def history_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation records as they are appended to a folder, with their time."""
    return spark.readStream.schema(RECORD).json(folder).withColumn("ts", F.to_timestamp("timestamp"))


def windowed_quality(records: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Mean metrics of each time window; records later than `late` are dropped."""
    return records.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("noise_rate").alias("noise_rate"), F.count("*").alias("records"))


def keep_chunks(store, source: str = "chunks"):
    """A foreachBatch function that keeps the chunks of the files (file_id, content) of each micro-batch up to date.

    Only the buckets of changed files are written. A file whose chunks are the same keeps its rows; of others the chunks
    that are gone take their vectors with them. Chunks, vectors and the number of the batch go into one commit, so a batch that
    is played again changes nothing. Of rows that repeat a file_id in a batch the greatest content counts; a null or
    empty content leaves the file without chunks. `source` tells the streams of one store apart.
    """

    def run(batch: DataFrame, number: int) -> None:
        done = store.find("batches", source=source)
        if done and done["batch"] >= number:
            return
        rows = batch.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.coalesce("content", F.lit(""))).alias("content")).persist()
        try:
            fresh = chunks.line_chunks(rows.where("content <> ''"))
            fresh = fresh.withColumn("id", F.xxhash64("file_id", "start_line", "content_hash"))
            with store.transaction() as t:
                stored = t.touched_rows("code_chunks", rows.select("file_id")).join(rows.select("file_id"), "file_id", "left_semi")
                same = chunks.unchanged_files(stored, fresh)
                changed = rows.select("file_id").join(same, "file_id", "left_anti")
                new = fresh.join(same, "file_id", "left_anti").select(stored.columns)
                gone = stored.join(changed, "file_id", "left_semi").select("id").join(new.select("id"), "id", "left_anti")
                t.delete("code_embeddings", gone)
                t.replace("code_chunks", changed, new)
                t.upsert("batches", batch.sparkSession.createDataFrame([(source, number)], "source string, batch long"), "source")
        finally:
            rows.unpersist()

    return run
