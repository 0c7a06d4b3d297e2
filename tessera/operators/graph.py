"""Edges between files: imports, references by name, and co-change statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed

#: Rows of a task: tasks grow in number, not in size.
TASK_ROWS = 150_000
#: A commit's files are cut to the first ones in so many parts, which then meet.
PARTS = 64
#: Commits are dealt by so many buckets for each task; with few, one task gets much more than its share.
BUCKETS = 64


def tasks(rows: DataFrame, n: int | None = None) -> int:
    """How many tasks share the rows, or `n` rows where they are dear to count; small tables take fewer rows each."""
    n = rows.count() if n is None else n
    return max(-(-n // TASK_ROWS), min(-(-n // 20_000), rows.sparkSession.sparkContext.defaultParallelism), 1)


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, target_id, path): each import whose text equals a file's path; repeated imports stay."""
    return imports.select("file_id", "source_path").join(files.select(F.col("id").alias("target_id"), "path"), F.col("source_path") == F.col("path")).select("file_id", "target_id", "path")


def reverse_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(target_id, file_id): the different files that import each file."""
    return import_edges(imports, files).select("target_id", "file_id").repartition(tasks(imports), "target_id", "file_id").distinct()


def files_with_names(rows: DataFrame, name: str, wanted: DataFrame, most: int | None = None) -> DataFrame:
    """(file_id, name): different pairs whose name is among `wanted` (one column, name).

    The pairs are dealt to tasks by the count of rows, or by `most` where that is dear; it shares work and cuts nothing.
    """
    found = rows.select("file_id", F.col(name).alias("name")).join(wanted.select("name"), "name", "left_semi")
    return found.select("file_id", "name").repartition(tasks(rows, most), "file_id", "name").distinct()


def cochange(commits: DataFrame, min_commits: int = fixed.MIN_COCHANGE_COMMITS, min_correlation: float = fixed.MIN_COCHANGE_CORRELATION, most: int = fixed.MAX_FILES_PER_COMMIT) -> DataFrame:
    """(file_a, file_b, commit_count, correlation) of files that change together.

    commits: commit, pos, file, with one row for each file of a commit. Of a commit the first `most` files by (pos,
    file) count, so the pairs of one commit are bounded. correlation = pairs / sqrt(count a * count b). Null files and
    repeated files of a commit count once at most.
    """
    rows = commits.where("file IS NOT NULL")
    n = tasks(rows)
    part, bucket = F.pmod(F.xxhash64("file"), F.lit(PARTS)), F.pmod(F.xxhash64("commit"), F.lit(BUCKETS * n))
    # a commit of very many files is cut to `most` in parts first
    once = rows.select("commit", "file", "pos", part.alias("part")).repartition(n, "commit", "part").groupBy("commit", "part", "file").agg(F.min("pos").alias("pos"))
    first = once.withColumn("rank", F.row_number().over(Window.partitionBy("commit", "part").orderBy("pos", "file"))).where(F.col("rank") <= most)
    rank = F.row_number().over(Window.partitionBy("commit", "bucket").orderBy("pos", "file"))
    kept = first.select("commit", "file", "pos", bucket.alias("bucket")).repartition(n, "bucket").withColumn("rank", rank).where(F.col("rank") <= most)
    counts = kept.groupBy("file").agg(F.count("*").alias("n"))
    # one row for each commit, its bounded files sorted: pairs come from it without joining the table with itself
    sets = kept.groupBy("commit", "bucket").agg(F.array_sort(F.collect_list("file")).alias("files")).where(F.size("files") > 1)
    pairs = sets.select("bucket", F.posexplode("files").alias("i", "file_a"), "files").select("bucket", "file_a", F.explode(F.slice("files", F.col("i") + 2, F.greatest(F.size("files") - F.col("i") - 1, F.lit(0)))).alias("file_b"))
    # added up where they arise, so a frequent pair travels once for each bucket
    pairs = pairs.groupBy("file_a", "file_b", "bucket").agg(F.count("*").alias("n")).repartition(n, "file_a", "file_b")
    pairs = pairs.groupBy("file_a", "file_b").agg(F.sum("n").alias("commit_count")).where(F.col("commit_count") >= min_commits)
    joined = pairs.join(counts.select(F.col("file").alias("file_a"), F.col("n").alias("n_a")), "file_a").join(counts.select(F.col("file").alias("file_b"), F.col("n").alias("n_b")), "file_b")
    scored = joined.withColumn("correlation", F.col("commit_count") / F.sqrt(F.col("n_a") * F.col("n_b")))
    return scored.where(F.col("correlation") >= min_correlation).select("file_a", "file_b", "commit_count", "correlation")


def cochange_neighbours(pairs: DataFrame, min_correlation: float = fixed.MIN_COCHANGE_READ) -> DataFrame:
    """(file, other, correlation, commit_count) from both ends of every pair, without repeats."""
    strong = pairs.where(F.col("correlation") >= min_correlation)
    return strong.select(F.col("file_a").alias("file"), F.col("file_b").alias("other"), "correlation", "commit_count").union(strong.select("file_b", "file_a", "correlation", "commit_count")).distinct()


def structural_union(imports: DataFrame, pairs: DataFrame, min_correlation: float = 0.3) -> DataFrame:
    """Different targets of a file over imports (file, other) and strong co-change."""
    found = imports.select("file", "other").union(cochange_neighbours(pairs, min_correlation).select("file", "other"))
    return found.repartition(tasks(imports), "file", "other").distinct()
