"""Which summaries are missing or out of date, in which batches they are asked for, and what comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import jsonx, text


def pending_symbols(symbols: DataFrame, summaries: DataFrame) -> DataFrame:
    """Functions and methods (id, kind, body, ...) whose body's hash is not the stored summary's."""
    wanted = symbols.where(F.col("kind").isin("function", "method")).withColumn("content_hash", text.content_hash(F.col("body")))
    return wanted.join(summaries.select(F.col("symbol_id").alias("id"), "content_hash"), ["id", "content_hash"], "left_anti")


def batch_plan(rows: DataFrame, by: str, order: str, size: int = fixed.SUMMARY_BATCH) -> DataFrame:
    """Adds batch (from 0 within each group) and single (the batch has one row)."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    out = rows.withColumn("batch", F.floor(n / size))
    return out.withColumn("single", F.count("*").over(Window.partitionBy(by, "batch")) == 1)


def match_batch(requests: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries by (batch, name) of batch answers, and the requests that must be asked for alone.

    requests: batch, id, name; of repeated names in a batch the last id takes the summary.
    """
    found = responses.select("batch", F.explode(jsonx.batch_summaries(F.col("response"))).alias("name", "summary"))
    last = requests.groupBy("batch", "name").agg(F.max("id").alias("id"))
    done = last.join(found, ["batch", "name"]).select("id", "summary")
    return done, requests.join(found.select("batch", "name"), ["batch", "name"], "left_anti")


def summary_rows(done: DataFrame, level: str) -> DataFrame:
    """Store rows of (id, summary, content_hash); a symbol's row has no file."""
    is_symbol = level != "file"
    return done.select(
        F.xxhash64(F.lit(level), "id").alias("id"),
        (F.col("id") if is_symbol else F.lit(None).cast("long")).alias("symbol_id"),
        (F.lit(None).cast("long") if is_symbol else F.col("id")).alias("file_id"),
        F.lit(level).alias("level"), "summary", "content_hash",
        text.estimate_tokens(F.col("summary"), fixed.SUMMARY_BYTES_PER_TOKEN).cast("int").alias("token_count"),
        F.current_timestamp().alias("generated_at"),
    )


def file_levels(symbols: DataFrame, summaries: DataFrame) -> DataFrame:
    """(file_id, children, content_hash) of files with summarised symbols; the hash covers `name:summary` lines in order."""
    joined = symbols.select(F.col("id").alias("symbol_id"), "file_id", "name", "start_line").join(summaries.where("symbol_id IS NOT NULL").select("symbol_id", "summary"), "symbol_id")
    children = F.array_sort(F.collect_list(F.struct("start_line", "name", "summary")))
    lines = F.array_join(F.transform(children, lambda c: F.concat(c["name"], F.lit(":"), c["summary"])), "\n")
    return joined.groupBy("file_id").agg(F.transform(children, lambda c: F.struct(c["name"].alias("name"), c["summary"].alias("summary"))).alias("children"), text.content_hash(lines).alias("content_hash"))


def cost(rows: DataFrame, per_million_in: float, per_million_out: float) -> DataFrame:
    """Adds the cost of each call: characters / 4 are tokens; a null prompt or response has none."""
    tokens = lambda c: F.coalesce(F.length(c), F.lit(0)) / 4
    return rows.withColumn("cost", (tokens("prompt") * per_million_in + tokens("response") * per_million_out) / 1e6)


def extrapolate(priced: DataFrame, units: tuple[int, ...]) -> DataFrame:
    """(units, calls, cost, per_unit): what so many units would cost at the mean of the priced calls (cost); no calls: no rows."""
    mean = priced.agg(F.count("*").alias("calls"), F.avg("cost").alias("per_unit")).where("calls > 0")
    return mean.select(F.explode(F.array(*(F.lit(u).cast("long") for u in units))).alias("units"), "calls", "per_unit").select("units", "calls", (F.col("units") * F.col("per_unit")).alias("cost"), "per_unit")
