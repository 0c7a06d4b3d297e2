"""Four kinds of evidence that a file is related to a change, fused to one ranked list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.operators import graph, vector

#: Evidence rows: file_id, method, reason, value. `value` is a similarity, a correlation or 1 for a keyword.
EVIDENCE = ("file_id", "method", "reason", "value")


def structural(changed: DataFrame, files: DataFrame, imports: DataFrame, pairs: DataFrame, min_correlation: float = fixed.MIN_COCHANGE_READ) -> DataFrame:
    """Imports of changed files (repeats count), files that import them (once), and co-change partners."""
    edges = graph.import_edges(imports, files)
    ours = changed.select(F.col("id").alias("file_id"))
    forward = edges.join(ours, "file_id", "left_semi").select(F.col("target_id").alias("file_id"), F.lit("direct_import").alias("reason"), F.lit(fixed.DIRECT_IMPORT).alias("value"))
    back = graph.reverse_imports(imports, files).join(ours.withColumnRenamed("file_id", "target_id"), "target_id", "left_semi").select("file_id", F.lit("reverse_import").alias("reason"), F.lit(fixed.REVERSE_IMPORT).alias("value"))
    together = graph.cochange_neighbours(pairs, min_correlation).join(ours.withColumnRenamed("file_id", "file"), "file", "left_semi").select(F.col("other").alias("file_id"), F.lit("cochange").alias("reason"), F.col("correlation").alias("value"))
    found = forward.unionByName(back).unionByName(together).join(ours, "file_id", "left_anti")
    return found.select("file_id", F.lit("structural").alias("method"), "reason", "value")


def semantic(changed: DataFrame, summaries: DataFrame, k: int = fixed.KNN_K) -> DataFrame:
    """Summaries nearest to each changed file's vector (id, embedding).

    summaries: id, file_id (null for symbols), embedding. The k nearest of the whole table are taken first; those
    without a file and changed files are dropped after, so they use up places.
    """
    hits = vector.knn(changed.select(F.col("id").alias("query_id"), "embedding"), summaries.select("id", "embedding"), k)
    found = hits.join(summaries.select("id", "file_id"), "id").where("file_id IS NOT NULL").join(changed.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    return found.select("file_id", F.lit("semantic").alias("method"), F.lit(None).cast("string").alias("reason"), F.greatest(1 - F.col("distance"), F.lit(0.0)).alias("value"))


def code_semantic(changed: DataFrame, chunks: DataFrame, k: int = fixed.KNN_K) -> DataFrame:
    """Files with a chunk near each changed file's vector: the nearest chunk of a file counts, similarity above zero."""
    hits = vector.knn(changed.select(F.col("id").alias("query_id"), "embedding"), chunks.select("id", "embedding"), k)
    found = hits.join(chunks.select("id", "file_id"), "id").join(changed.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    near = vector.min_per_group(found, "file_id").withColumn("value", 1 - F.col("distance")).where("value > 0")
    return near.select("file_id", F.lit("code_semantic").alias("method"), F.lit(None).cast("string").alias("reason"), "value")


def keyword(changed: DataFrame, symbols: DataFrame, refs: DataFrame, names: DataFrame, most_names: int | None = None) -> DataFrame:
    """One row for each different name that a file defines, and one for each that it refers to."""
    defined = graph.files_with_names(symbols, "name", names, most_names).withColumn("reason", F.lit("defines"))
    used = graph.files_with_names(refs, "symbol_name", names, most_names).withColumn("reason", F.lit("references"))
    found = defined.unionByName(used).join(changed.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    return found.select("file_id", F.lit("keyword").alias("method"), "reason", F.lit(1.0).alias("value"))


def contribution(weights: dict[str, float] | None = None) -> F.Column:
    """What an evidence row adds to a file's score. Every keyword match is an entry of one term."""
    w = fixed.WEIGHTS | (weights or {})
    value = F.col("value").cast("double")
    return (
        F.when(F.col("method") == "structural", w["structural"] * value)
        .when(F.col("method") == "semantic", w["semantic"] * F.greatest(value, F.lit(0.0)))
        .when(F.col("method") == "code_semantic", w["code_semantic"] * F.greatest(value, F.lit(0.0)))
        .when(F.col("method") == "keyword", w["keyword"] * F.least(value, F.lit(float(fixed.MAX_KEYWORD_TERMS))) / fixed.MAX_KEYWORD_TERMS)
        .otherwise(0.0)
    )


def fuse(evidence: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(file_id, score, entries): the sum of all contributions of a file."""
    return evidence.groupBy("file_id").agg(F.sum(contribution(weights)).alias("score"), F.count("*").alias("entries"))


def method_counts(evidence: DataFrame) -> DataFrame:
    """Different files of each method, one row."""
    # a file's methods are told by flags: rows are not copied for each method, and a task holds a file once
    found = evidence.where("file_id IS NOT NULL").groupBy("file_id").agg(*(F.max(F.col("method") == m).alias(m) for m in fixed.WEIGHTS))
    return found.agg(*(F.count_if(m).alias(m) for m in fixed.WEIGHTS))


def retrieve(changed: DataFrame, files: DataFrame, imports: DataFrame, pairs: DataFrame, symbols: DataFrame, refs: DataFrame, names: DataFrame, summaries: DataFrame | None = None, chunks: DataFrame | None = None, vectors: DataFrame | None = None, weights: dict[str, float] | None = None, min_correlation: float = fixed.MIN_COCHANGE_READ, most_names: int | None = None) -> DataFrame:
    """(file_id, path, score, entries), best first, ties by path. Without vectors both vector methods give nothing.

    vectors: (id, kind, embedding) of the changed files, kind `summary` or `code`. most_names: see files_with_names().
    """
    evidence = structural(changed, files, imports, pairs, min_correlation).unionByName(keyword(changed, symbols, refs, names, most_names))
    if vectors is not None and summaries is not None:
        evidence = evidence.unionByName(semantic(vectors.where("kind = 'summary'"), summaries))
    if vectors is not None and chunks is not None:
        evidence = evidence.unionByName(code_semantic(vectors.where("kind = 'code'"), chunks))
    ranked = fuse(evidence, weights).join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return ranked.select("file_id", "path", "score", "entries").orderBy(F.desc("score"), "path")


def chunk_text(chunks: DataFrame) -> DataFrame:
    """(file_id, text): all chunks of a file joined by line feeds in order; overlaps repeat."""
    parts = F.array_sort(F.collect_list(F.struct("start_line", "content")))
    return chunks.groupBy("file_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("text"))
