"""The run that summarises symbols and then files, wave by wave, and stores what comes back."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import text
from tessera.operators import budget, report, summaries
from tessera.sources.connectors import ChatModel, complete_column
from tessera.sources.store import Store, file_ids

SYSTEM = "You describe source code for a search index. Answer with the plain summary alone."
BATCH_SYSTEM = "You describe source code for a search index. Answer with one JSON object from each symbol's name to its summary."


@dataclass
class Stats:
    """What a run did; `stopped` is why it ended early, by phase."""

    symbols: int = 0
    files: int = 0
    symbols_unchanged: int = 0
    files_unchanged: int = 0
    errors: int = 0
    rate_limited: bool = False
    provider_limited: bool = False
    stopped: dict[str, str] | None = None


class Run:
    """One run over a store. What is asked and what is answered is written beside the tables, so no call is made twice for
    one wave, and a stored summary replaces the one that it renews."""

    def __init__(self, store: Store, model: ChatModel, concurrency: int, clock: Callable[[], float]):
        self.store, self.model, self.clock = store, model, clock
        self.concurrency = max(concurrency, 1)
        self.at = f"{store.root}/runs/{uuid.uuid4().hex}"
        self.stats = Stats(stopped={})

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        """rows, written and read again."""
        rows.write.mode("overwrite").parquet(f"{self.at}/{name}")
        return self.store.spark.read.schema(rows.schema).parquet(f"{self.at}/{name}")

    def waves(self, requests: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Requests dealt by a hash to waves of about `concurrency` calls: no order over all of them is needed."""
        count = -(-requests.count() // self.concurrency)
        wave = F.pmod(F.xxhash64("id"), F.lit(max(count, 1))).cast("int")
        requests.withColumn("wave", wave).write.mode("overwrite").partitionBy("wave").parquet(f"{self.at}/{name}")
        schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in requests.schema)}, wave int"
        return self.store.spark.read.schema(schema).parquet(f"{self.at}/{name}"), count

    def ask(self, requests: DataFrame, phase: str, take: Callable[[DataFrame], None], state: dict, started: float) -> DataFrame | None:
        """Asks (id, system, user, size) wave by wave until pressure ends the phase; take() gets the answers of each wave.
        Gives the requests that failed, None if the phase was ended."""
        dealt, count = self.waves(requests, f"{phase}_asked")
        failed = None
        for k in range(count):
            wave = dealt.where(F.col("wave") == k)
            answers = self.keep(complete_column(wave, self.model, self.concurrency, fixed.SUMMARY_OUTPUT_TOKENS).join(wave.select("id", "size"), "id"), f"{phase}_answers/{k}")
            good = answers.where("error IS NULL")
            bad = answers.where("error IS NOT NULL")
            took = answers.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum(F.when(F.col("reducible"), F.col("size"))), F.lit(0)).alias("pressed"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if("rate_limited").alias("limited")).first()
            if took["errors"] < took["size"]:
                take(good)
            failed = bad.select("id") if failed is None else failed.unionByName(bad.select("id"))
            self.stats.errors += took["errors"]
            if why := budget.pressure_step(state, took["size"], took["pressed"], self.clock() - started):
                self.stats.provider_limited, self.stats.rate_limited = True, self.stats.rate_limited or took["limited"] > 0
                self.stats.stopped[phase] = why
                return None
        return failed if failed is not None else requests.select("id")

    def save(self, done: DataFrame, level: str) -> int:
        """Stores (id, summary, content_hash), one row for each id, and gives their number."""
        rows = self.store.spark.read.schema(done.schema).parquet(self._written(done))
        self.store.upsert("summaries", summaries.summary_rows(rows, level), "id")
        return rows.count()

    def _written(self, rows: DataFrame) -> str:
        path = f"{self.at}/done/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def drop_stale(self, due: DataFrame, key: str, level_is_file: bool) -> None:
        """Removes the stored summaries of what is asked again, and their vectors."""
        held = self.store.read("summaries").where((F.col("level") == "file") if level_is_file else F.col("symbol_id").isNotNull())
        ids = self.keep(held.join(due.select(F.col("id").alias(key)), key, "left_semi").select("id"), f"stale_{key}")
        if not ids.isEmpty():
            with self.store.transaction() as t:
                t.delete("summary_embeddings", ids)
                t.delete("summaries", ids)

    def symbols(self, wanted: DataFrame, started: float) -> None:
        """wanted: id, file_id, path, name, kind, start_line, body of functions and methods."""
        stored = self.store.read("summaries").where("symbol_id IS NOT NULL")
        due = self.keep(summaries.pending_symbols(wanted, stored).withColumn("ord", F.struct("kind", "start_line", "id")), "due")
        self.stats.symbols_unchanged = wanted.count() - due.count()
        self.drop_stale(due, "symbol_id", False)
        plan = self.keep(summaries.batch_plan(due, "file_id", "ord").withColumnRenamed("batch", "part").withColumn("batch", F.xxhash64("file_id", "part")), "plan")
        many = plan.where("NOT single")
        held = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "kind", "body"))), lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"), s["body"].alias("body")))
        batches = many.groupBy("batch", "path").agg(held.alias("held"), F.count("*").alias("size"))
        state = {"total": 0, "streak": 0}
        matched: list[str] = []

        def take_batches(answers: DataFrame) -> None:
            asked = many.join(answers.select(F.col("id").alias("batch")), "batch", "left_semi")
            done, _ = summaries.match_batch(asked.select("batch", "id", "name"), answers.select(F.col("id").alias("batch"), "response"))
            path = self._written(done.join(plan.select("id", "name", "batch", "content_hash"), "id"))
            matched.append(path)
            self.stats.symbols += self.save(self.store.spark.read.parquet(path).select("id", "summary", "content_hash"), "function")

        requests = batches.select(F.col("batch").alias("id"), F.lit(BATCH_SYSTEM).alias("system"), report.batch_prompt(F.col("path"), F.col("held")).alias("user"), "size")
        if self.ask(requests, "batches", take_batches, state, started) is None:
            return
        alone = plan
        if matched:  # a name that was answered answers all its namesakes in the batch
            alone = plan.join(self.store.spark.read.parquet(*matched).select("batch", "name"), ["batch", "name"], "left_anti")

        def take_single(answers: DataFrame) -> None:
            self.stats.symbols += self.save(answers.join(plan.select("id", "content_hash"), "id").select("id", F.col("response").alias("summary"), "content_hash"), "function")

        prompt = report.symbol_prompt(F.col("path"), F.col("name"), F.col("kind"), F.col("body"))
        self.ask(alone.select("id", F.lit(SYSTEM).alias("system"), prompt.alias("user"), F.lit(1).cast("long").alias("size")), "singles", take_single, state, started)

    def files(self, symbols: DataFrame, paths: DataFrame) -> None:
        """File summaries from those of their symbols; paths: id, path."""
        held = self.store.read("summaries")
        levels = self.keep(summaries.file_levels(symbols, held).withColumnRenamed("file_id", "id"), "levels")
        same = held.where("level = 'file'").select(F.col("file_id").alias("id"), "content_hash")
        due = self.keep(levels.join(same, ["id", "content_hash"], "left_anti").join(paths, "id"), "files_due")
        self.stats.files_unchanged = levels.join(same, ["id", "content_hash"], "left_semi").count()
        self.drop_stale(due, "file_id", True)

        def take(answers: DataFrame) -> None:
            self.stats.files += self.save(answers.join(due.select("id", "content_hash"), "id").select("id", F.col("response").alias("summary"), "content_hash"), "file")

        requests = due.select("id", F.lit(SYSTEM).alias("system"), report.file_prompt(F.col("path"), F.col("children")).alias("user"), F.lit(1).cast("long").alias("size"))
        self.ask(requests, "files", take, {"total": 0, "streak": 0}, self.clock())


def body(content: Column, start: Column, end: Column) -> Column:
    return text.line_slice(content, start, end)


def summarise(store: Store, contents: DataFrame, model: ChatModel, concurrency: int = 4, paths: DataFrame | None = None, clock: Callable[[], float] = time.monotonic) -> Stats:
    """Summaries of functions and methods, then of files from those, where the hash of what they describe is not the stored one.

    contents: path, content of the indexed files; a symbol whose file or lines are not there is passed over. paths: only
    the files at these paths (path). Symbols of a file are asked for in batches; what a batch leaves out, or fails with, is asked for alone.
    Calls go out in waves of about `concurrency`; sustained pressure ends a phase, and files follow with what is there.
    """
    files = store.read("files").select("id", "path")
    if paths is not None:
        files = file_ids(store.read("files"), paths).select("id", "path")
    run = Run(store, model, concurrency, clock)
    files = run.keep(files, "chosen")
    symbols = store.read("symbols").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    functions = symbols.where(F.col("kind").isin("function", "method"))
    bodies = functions.join(contents.select("path", "content"), "path").withColumn("body", body(F.col("content"), F.col("start_line"), F.col("end_line")))
    wanted = run.keep(bodies.where("body IS NOT NULL").select("id", "file_id", "path", "name", "kind", "start_line", "body"), "wanted")
    run.symbols(wanted, clock())
    run.files(symbols.drop("path"), files)
    store.clear(run.at)
    return run.stats
