"""Votes of similar earlier findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.operators import vector


def signal_text(file: str = "file", explanation: str = "explanation", impact: str = "impact") -> F.Column:
    """What is embedded of a finding."""
    return F.concat(F.col(file), F.lit(": "), F.col(explanation), F.lit(" — "), F.col(impact))


def collect_signals(store, team: str, signals: DataFrame, embedder: vector.Embedder) -> int:
    """Stores signals (id, signal_type, file, explanation, impact, category) of a team with the vectors of their texts; how many."""
    rows = signals.select("id", F.lit(team).alias("team_id"), "signal_type", signal_text().alias("finding_text"), F.col("category").alias("finding_category"), F.current_timestamp().alias("ts"))
    with store.transaction() as t:
        t.append("feedback_embeddings", vector.embed_texts(rows.select("id", F.col("finding_text").alias("text")), embedder))
        t.append("feedback_signals", rows)
    return rows.count()


def signal_count(signals: DataFrame, team: str) -> int:
    return signals.where(F.col("team_id") == team).count()


def similar_signals(findings: DataFrame, signals: DataFrame, team: str, k: int = fixed.FEEDBACK_KNN_K) -> DataFrame:
    """(query_id, id, distance, signal_type): the k nearest signals of all teams first, then only the team's."""
    hits = vector.knn(findings.select(F.col("id").alias("query_id"), "embedding"), signals.select("id", "embedding"), k)
    return hits.join(signals.where(F.col("team_id") == team).select("id", "signal_type"), "id").select("query_id", "id", "distance", "signal_type")


def apply_feedback(findings: DataFrame, signals: DataFrame, team: str, min_confidence: float = fixed.MIN_CONFIDENCE, min_signals: int = fixed.FEEDBACK_MIN_SIGNALS, max_distance: float = fixed.MAX_SIMILAR_DISTANCE, k: int = fixed.FEEDBACK_KNN_K) -> DataFrame:
    """Findings (id, confidence, embedding, ...) after the votes of the team's signals.

    With fewer signals than `min_signals` all stay as they are. Three near dismissed signals drop a finding; else three
    near accepted ones raise its confidence, to 1 at most; then the threshold holds. A finding without an embedding
    has no votes and stays.
    """
    if signal_count(signals, team) < min_signals:
        return findings
    near = similar_signals(findings, signals, team, k).where(F.col("distance") <= max_distance)
    votes = near.groupBy(F.col("query_id").alias("id")).agg(F.count_if(F.col("signal_type") == "dismissed").alias("_no"), F.count_if(F.col("signal_type") == "accepted").alias("_yes"))
    joined = findings.join(votes, "id", "left").where(F.coalesce("_no", F.lit(0)) < fixed.DISMISSED_TO_DROP)
    raised = F.when(F.coalesce("_yes", F.lit(0)) >= fixed.ACCEPTED_TO_BOOST, F.least(F.col("confidence") + fixed.ACCEPTED_BOOST, F.lit(1.0))).otherwise(F.col("confidence"))
    return joined.withColumn("confidence", raised).where((F.col("confidence") >= min_confidence) | F.col("embedding").isNull()).select(findings.columns)
