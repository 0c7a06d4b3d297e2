"""Findings of a review: filtered, verified, deduplicated, fingerprinted, compared with earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import text


def deduplicate(findings: DataFrame, order: str = "ord") -> DataFrame:
    """Of each (file, start_line, category) the first finding of the highest confidence, at the place of the first seen."""
    key = Window.partitionBy("file", "start_line", "category")
    best = F.row_number().over(key.orderBy(F.desc("confidence"), order))
    first = F.min(order).over(key)
    return findings.withColumn("_best", best).withColumn("_first", first).where("_best = 1").drop("_best", order).withColumnRenamed("_first", order)


def apply_filters(findings: DataFrame, min_confidence: float = fixed.MIN_CONFIDENCE, suppress_style: bool = True) -> DataFrame:
    """Confident findings with evidence and impact that do not take themselves back and are not style only, deduplicated."""
    kept = (F.col("confidence") >= min_confidence) & F.col("evidence").rlike(r"(?U)\S") & F.col("impact").rlike(r"(?U)\S") & ~text.is_self_dismissed(F.col("explanation"), F.col("impact"))
    if suppress_style:
        kept &= F.col("category") != "style"
    return deduplicate(findings.where(kept))


def verify(findings: DataFrame, contents: DataFrame) -> DataFrame:
    """Lower confidence where the file (path, content) is missing or holds none of the code that the evidence quotes."""
    candidates = text.code_candidates(F.col("evidence"))
    joined = findings.join(contents.select(F.col("path").alias("file"), F.col("content").alias("_content")), "file", "left")
    found = (F.size(candidates) == 0) | F.exists(candidates, lambda c: F.contains(F.col("_content"), c))
    confidence = F.when(F.col("_content").isNull(), F.col("confidence") - fixed.MISSING_FILE_PENALTY).when(~found, F.col("confidence") - fixed.MISSING_EVIDENCE_PENALTY).otherwise(F.col("confidence"))
    return joined.withColumn("confidence", F.greatest(confidence, F.lit(0.0))).drop("_content").select(findings.columns)


def threshold(findings: DataFrame, min_confidence: float = fixed.MIN_CONFIDENCE) -> DataFrame:
    return findings.where(F.col("confidence") >= min_confidence)


def fingerprints(findings: DataFrame, order: str = "ord") -> DataFrame:
    """Adds fp_id and line_id; the n-th finding of equal hash gets `:n-1` after it."""
    def numbered(name: str) -> Column:
        n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
        return F.when(n > 0, F.concat(F.col(name), F.lit(":"), n.cast("string"))).otherwise(F.col(name))

    hashed = findings.withColumn("fp_id", text.content_fingerprint(F.col("file"), F.col("category"), F.col("evidence")))
    hashed = hashed.withColumn("line_id", text.line_fingerprint(F.col("file"), F.col("start_line"), F.col("end_line"), F.col("category")))
    return hashed.withColumn("fp_id", numbered("fp_id")).withColumn("line_id", numbered("line_id"))


def stale(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Prior findings (fp_id, line_id) of which neither id is an id of a current one; none if there is no current one."""
    keys = current.select(F.col("fp_id").alias("key")).union(current.select("line_id")).where("key IS NOT NULL").distinct()
    numbered = prior.withColumn("_row", F.xxhash64(F.coalesce("fp_id", F.lit("")), F.coalesce("line_id", F.lit(""))))
    kept = numbered.select("_row", F.explode(F.array("fp_id", "line_id")).alias("key")).join(keys, "key", "left_semi").select("_row").distinct()
    gone = numbered.join(kept, "_row", "left_anti").drop("_row")
    return gone.join(keys.limit(1).select(F.lit(1).alias("_any")), F.col("_any") == 1, "left_semi")


def empty_review_reason(has_findings: Column, summary: Column, quality: Column, response: Column, repaired_summary: Column | None = None, repaired_quality: Column | None = None, repaired_response: Column | None = None) -> Column:
    """Why a review without findings proves nothing, or null."""
    claims = text.claims_findings(F.coalesce(summary, F.lit("")))
    language = text.claims_findings(F.coalesce(response, F.lit("")))
    if repaired_summary is not None:
        claims |= text.claims_findings(F.coalesce(repaired_summary, F.lit("")))
    if repaired_response is not None:
        language |= text.claims_findings(F.coalesce(repaired_response, F.lit("")))
    unstructured = F.lit(False) if repaired_quality is None else repaired_quality.isNotNull() & ~repaired_quality.isin("strict", "flexible")
    return (
        F.when(has_findings, None)
        .when(claims, "summary_claims_findings")
        .when(unstructured, "repair_did_not_produce_structured_review")
        .when((quality == "malformed") & language, "malformed_response_contains_finding_language")
    )


def outcome(inconclusive: Column, has_findings: Column, limited: Column) -> Column:
    return F.when(inconclusive.isNotNull(), "inconclusive").when(has_findings, "findings").when(limited, "limited_clean").otherwise("clean")


def fails(result: Column, mode: str) -> Column:
    """Whether an inconclusive review ends in failure."""
    return (result == "inconclusive") & F.lit(mode == "fail")
