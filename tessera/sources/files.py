"""Commit logs, evaluation history, fixtures and settings."""

from __future__ import annotations

import json
import os
import subprocess
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import fixed

RECORD = (
    "timestamp string, git_sha string, fixture_count long, precision double, recall double, noise_rate double, gates_passed boolean, "
    "per_fixture array<struct<name:string,expected:long,actual:long,tp:long,fp:long,fn_count:long,inconclusive:boolean,error:string>>"
)


#: Lines of a log that one task carries a commit over; what opens a record in a log that write_log() made.
LOG_LINES, RECORD_MARK = 100_000, "\x1e"


def commit_files(log: DataFrame, lines: int = LOG_LINES) -> DataFrame:
    """(commit, pos, file) of the lines (line_no, line) of `git log --name-only --format=%H --no-merges`.

    A line of 40 hexadecimal digits opens a commit; blank lines mean nothing, wherever they stand. Runs of `lines` line
    numbers are carried each by itself; what a run takes over from those before comes from one row for each run.
    """
    rows = log.where(F.length(F.trim("line")) > 0).withColumns({"sha": F.when(F.col("line").rlike("^[0-9a-f]{40}$"), F.col("line")), "run": F.floor(F.col("line_no") / lines)})
    last = rows.where("sha IS NOT NULL").groupBy("run").agg(F.max_by("sha", "line_no").alias("last"))
    starts = rows.select("run").distinct().join(last, "run", "left")
    over = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row for each run of lines
    starts = starts.select("run", F.last("last", ignorenulls=True).over(over).alias("before"))
    inside = Window.partitionBy("run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.last("sha", ignorenulls=True).over(inside)).where("sha IS NULL").join(starts, "run")
    return rows.select(F.coalesce("own", "before").alias("commit"), F.col("line_no").alias("pos"), F.col("line").alias("file")).where("commit IS NOT NULL")


def write_log(repo: str, path: str, limit: int | None = None) -> str:
    """Streams the log of a local repository to a file of records, each opened by RECORD_MARK; the log is never held whole."""
    command = ["git", "-C", repo, "log", "--name-only", f"--format={RECORD_MARK}%H", "--no-merges", *([f"-{limit}"] if limit else [])]
    with open(path, "wb") as out:
        subprocess.run(command, stdout=out, check=True)
    return path


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, pos, file) of a file or folder that holds logs of write_log().

    A record is cut at its mark while the file is read, wherever the file is split among tasks, so no line needs what stands
    before its record. Blank lines mean nothing; a record that does not start with 40 hexadecimal digits is an error;
    pos counts the files of a commit from 0.
    """
    records = spark.read.option("lineSep", RECORD_MARK).text(path).where(F.length(F.trim("value")) > 0)
    parts = F.split("value", "\n")
    sha = F.trim(F.get(parts, F.lit(0)))
    checked = F.when(sha.rlike("^[0-9a-f]{40}$"), sha).otherwise(F.raise_error(F.concat(F.lit("no commit opens the record: "), F.substring("value", 1, 80))))
    files = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda f: F.length(F.trim(f)) > 0)
    return records.select(checked.alias("commit"), F.posexplode(files).alias("pos", "file")).select("commit", F.col("pos").cast("long").alias("pos"), F.col("file"))


def git_log(spark: SparkSession, repo: str, folder: str, limit: int | None = None) -> DataFrame:
    """read_log() of a local repository's log, by way of a file in `folder`, which on a cluster all machines share."""
    return read_log(spark, write_log(repo, os.path.join(folder, "log.txt"), limit))


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records, one JSON object a line, with `ord`; a missing file is empty, a malformed line an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], RECORD + ", ord long")
    held = spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)
    return held.withColumn("ord", F.row_number().over(Window.orderBy("timestamp", F.monotonically_increasing_id())).cast("long"))  # a row for each evaluation


def save_record(records: DataFrame, path: str) -> None:
    """Appends records to a history folder."""
    records.select([f.split(" ")[0] for f in ("timestamp", "git_sha", "fixture_count", "precision", "recall", "noise_rate", "gates_passed", "per_fixture")]).coalesce(1).write.mode("append").json(path)


def load_fixtures(spark: SparkSession, root: str) -> DataFrame:
    """One row for each folder with a fixture.json: its fields, diff (change.patch), and files (path to content)."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://")[-1].rstrip("/")
    inside = F.element_at(F.split("path", base + "/", 2), -1)
    rows = held.select(F.split(inside, "/", 2)[0].alias("folder"), F.split(inside, "/", 2)[1].alias("file"), F.decode("content", "UTF-8").alias("content")).where("file IS NOT NULL")
    meta = "name string, description string, conventions string, expected_findings array<struct<file:string,start_line:int,category:string,acceptable_categories:array<string>>>"
    other = ~F.col("file").isin("fixture.json", "change.patch")
    out = rows.groupBy("folder").agg(
        F.max(F.when(F.col("file") == "fixture.json", F.col("content"))).alias("meta"),
        F.max(F.when(F.col("file") == "change.patch", F.col("content"))).alias("diff"),
        F.map_from_entries(F.collect_list(F.when(other, F.struct("file", "content")))).alias("files"),
    )
    return out.where("meta IS NOT NULL").select("folder", F.from_json("meta", meta).alias("m"), "diff", "files").select("folder", "m.*", "diff", "files").orderBy("name")


@dataclass
class Config:
    """Settings with defaults; a JSON file overrides them, and the environment (TESSERA_<NAME>) overrides both."""

    weights: dict = field(default_factory=lambda: dict(fixed.WEIGHTS))
    min_confidence: float = fixed.MIN_CONFIDENCE
    suppress_style_only: bool = True
    feedback_min_signals: int = fixed.FEEDBACK_MIN_SIGNALS
    max_tokens: int = fixed.MAX_TOKENS
    reserve_tokens: int = fixed.RESERVE_TOKENS
    max_files: int = fixed.MAX_FILES
    concurrency: int = 3
    endpoint: str = ""
    model: str = ""
    inconclusive: str = "warn"

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        held = json.loads(Path(path).read_text()) if path and Path(path).exists() else {}
        out = cls(**{f.name: held[f.name] for f in fields(cls) if f.name in held})
        for f in fields(cls):
            if (v := env.get(f"TESSERA_{f.name.upper()}")) is not None:
                kind = type(getattr(out, f.name))
                setattr(out, f.name, json.loads(v) if kind in (bool, dict) else kind(v))
        return out


def clean(repo: str, targets: tuple[str, ...] = (".tessera",)) -> list[str]:
    """Removes the tool's folders, only where they resolve strictly inside the repository."""
    import shutil

    root, removed = Path(repo).resolve(), []
    for t in targets:
        p = (root / t).resolve()
        if p != root and root in p.parents and p.exists():
            shutil.rmtree(p) if p.is_dir() else p.unlink()
            removed.append(str(p))
    return removed
