"""Line chunks of files, and which files need new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import text


def line_chunks(files: DataFrame, size: int = fixed.CHUNK_LINES, overlap: int = fixed.CHUNK_OVERLAP, content: str = "content") -> DataFrame:
    """One row for each chunk: the columns of files but `content`, start_line, end_line, content, content_hash."""
    rest = [c for c in files.columns if c != content]
    return files.select(*rest, F.inline(text.chunk_windows(F.col(content), size, overlap))).withColumn("content_hash", text.content_hash(F.col("content")))


#: Why a file is not chunked, in the order in which it is asked.
SKIPPED = ("no_language", "outside_root", "no_text", "too_large", "empty")


def skipped(files: DataFrame) -> F.Column:
    """One of SKIPPED, or null for a file that is chunked: a language, a path inside the root (if files have `path`), a text of at
    most MAX_FILE_BYTES and at least one line."""
    inside = F.coalesce(text.inside_root(F.col("path")), F.lit(False)) if "path" in files.columns else F.lit(True)
    return (
        F.when(F.coalesce(F.length("language"), F.lit(0)) == 0, SKIPPED[0])
        .when(~inside, SKIPPED[1])
        .when(F.col("content").isNull(), SKIPPED[2])
        .when(F.octet_length("content") > fixed.MAX_FILE_BYTES, SKIPPED[3])
        .when(F.length("content") == 0, SKIPPED[4])
    )


def eligible(files: DataFrame) -> DataFrame:
    """Files that are chunked."""
    return files.where(skipped(files).isNull())


def unchanged_files(stored: DataFrame, fresh: DataFrame, key: str = "file_id") -> DataFrame:
    """Keys whose chunk hashes are the same multiset in both tables."""
    def bag(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.array_sort(F.collect_list("content_hash")).alias(name))

    return bag(stored, "a").join(bag(fresh, "b"), key).where("a = b").select(key)


def refresh_chunks(stored: DataFrame, fresh: DataFrame, key: str = "file_id") -> DataFrame:
    """The chunk table after new chunks: unchanged files keep their rows, others get the new ones, missing ones stay."""
    same = unchanged_files(stored, fresh, key)
    new = fresh.join(same, key, "left_anti")
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def scan(files: DataFrame, stored: DataFrame, size: int = fixed.CHUNK_LINES, overlap: int = fixed.CHUNK_OVERLAP) -> tuple[DataFrame, DataFrame]:
    """A chunking scan of files (file_id, language, content, and path if there is one) against the stored chunks: the new chunks of changed files, and one row of counters.

    Chunks come in the order of file_id and start_line. Counters: files, each of SKIPPED, unchanged (their chunks are stored
    as they would come out), chunked (files), chunks. A stored file that is no longer chunked is not counted as unchanged.
    """
    counts = files.select(skipped(files).alias("why")).agg(F.count("*").alias("files"), *(F.count_if(F.col("why") == w).alias(w) for w in SKIPPED))
    fresh = line_chunks(eligible(files).select("file_id", "content"), size, overlap)
    same = unchanged_files(stored, fresh)
    new = fresh.join(same, "file_id", "left_anti")
    made = new.agg(F.count_distinct("file_id").alias("chunked"), F.count("*").alias("chunks"))
    return new.orderBy("file_id", "start_line"), counts.join(F.broadcast(same.agg(F.count("*").alias("unchanged")))).join(F.broadcast(made))  # one row each
