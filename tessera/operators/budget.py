"""Packing of context into a token budget, and trimming of prompts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera import fixed
from tessera.functions import text


def running(rows: DataFrame, group: str, order: list[Column | str], start: Callable[[], Any], step: Callable[[Any, dict], tuple], reads: list[str], adds: str) -> DataFrame:
    """rows with further columns, each row's from the state that its group has reached: step(state, row) -> values.

    A group is read in order, row by row, by one task, and only its state is held, so a group of any size needs no memory.
    step() gets the columns `reads` and changes the state in place; adds: the new columns as DDL.
    """
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(adds).fields])
    new = to_arrow_schema(StructType.fromDDL(adds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            values = []
            for g, *held in zip(*(batch.column(c).to_pylist() for c in (group, *reads)), strict=True):
                if g != now:
                    now, state = g, start()
                values.append(step(state, dict(zip(reads, held, strict=True))))
            columns = list(zip(*values, strict=True)) if values else [()] * len(new)
            added = [pa.array(c, f.type) for c, f in zip(columns, new, strict=True)]
            yield pa.record_batch([*batch.columns, *added], names=[*batch.schema.names, *new.names])

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def greedy_pack(items: DataFrame, budget: int, group: str = "group", order: str = "ord", tokens: str = "tokens", max_items: int = fixed.MAX_FILES) -> DataFrame:
    """Adds `kept` and `reason` to each item: in order, an item that does not fit is skipped and smaller ones go on.

    A running sum would be wrong, as it counts what was skipped; running() keeps what is used. A null size counts as zero.
    """

    def step(state: dict, row: dict) -> tuple:
        need = row[tokens] or 0
        if state["n"] >= max_items:
            return False, "max_files_exceeded"
        if state["used"] + need > budget:
            return False, "token_budget_exceeded"
        state["n"] += 1
        state["used"] += need
        return True, None

    return running(items, group, [order], lambda: {"used": 0, "n": 0}, step, [tokens], "kept boolean, reason string")


def hunk_counts(diffs: DataFrame, key: str = "change", diff: str = "diff") -> DataFrame:
    """(key, path, hunks): the `@@` lines of each file of each diff.

    A deleted file names no new file, so its hunks count for the file before it.
    """
    rows = diffs.select(key, F.posexplode(text.lines(F.col(diff))).alias("_n", "_line")).where(F.col("_line").startswith("+++ ") | F.col("_line").startswith("@@"))
    named = F.regexp_replace("_line", r"^\+\+\+ ([ab]/)?", "")
    path = F.when(F.col("_line").startswith("+++ ") & (named != "/dev/null"), named)
    current = F.last(path, ignorenulls=True).over(Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    counted = rows.select(key, "_line", current.alias("path")).where(F.col("_line").startswith("@@") & F.col("path").isNotNull())
    return counted.groupBy(key, "path").agg(F.count("*").alias("hunks"))


def by_hunks(changed: DataFrame, hunks: DataFrame, key: str = "change", order: str = "ord") -> DataFrame:
    """Changed files (key, path, ord, ...) with `hunks` and `rank`: most hunks first, equal ones in their order."""
    counted = changed.join(hunks, [key, "path"], "left").withColumn("hunks", F.coalesce("hunks", F.lit(0)))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("hunks"), order)))


def context_tiers(files: DataFrame, budget: int, key: str = "change", order: str = "rank") -> DataFrame:
    """Adds `tier` (full, summary_only or diff_only), `cost` and `omission` to the changed files of many changes.

    files: key, path, content (null: unreadable, shown as empty), summary, and the order by which they take from the budget.
    Full text costs content and summary; lock files, generated and very large ones never have it. A file that gets
    neither text nor summary costs its placeholder, even beyond the budget.
    """
    per = fixed.BYTES_PER_TOKEN
    forced = text.is_non_reviewable(F.col("path")) | (F.coalesce(F.octet_length("content"), F.lit(0)) > fixed.MAX_CHANGED_FILE_BYTES)
    sized = files.withColumns({
        "_forced": forced,
        "_summary": F.floor(F.octet_length("summary") / per).cast("long"),
        "_full": (F.floor(F.coalesce(F.octet_length("content"), F.lit(0)) / per) + F.coalesce(F.floor(F.octet_length("summary") / per), F.lit(0))).cast("long"),
    })

    def step(state: dict, row: dict) -> tuple:
        if row["_forced"]:
            tier, cost, why = "diff_only", tokens_of(fixed.EXCLUDED_TEXT), None
        elif row["_full"] <= state["left"]:
            tier, cost, why = "full", row["_full"], None
        elif row["_summary"] is not None and row["_summary"] <= state["left"]:
            tier, cost, why = "summary_only", row["_summary"], "content_degraded_to_summary"
        else:
            tier, cost, why = "diff_only", tokens_of(fixed.DIFF_ONLY_TEXT), "content_degraded_to_diff_only"
        state["left"] = max(state["left"] - cost, 0)
        return tier, cost, why

    out = running(sized, key, [order], lambda: {"left": budget}, step, ["_forced", "_summary", "_full"], "tier string, cost long, omission string")
    return out.drop("_forced", "_summary", "_full")


@dataclass
class Package:
    """Files of one change within a budget, and what was left out."""

    files: list[dict] = field(default_factory=list)
    omitted: list[dict] = field(default_factory=list)
    report: dict = field(default_factory=dict)


def tokens_of(content: str) -> int:
    return len(content.encode()) // fixed.BYTES_PER_TOKEN


def non_reviewable(path: str) -> bool:
    return path.rsplit("/", 1)[-1] in fixed.NON_REVIEWABLE_NAMES or path.endswith(fixed.NON_REVIEWABLE_SUFFIXES)


def hunks_of(diff: str) -> dict[str, int]:
    """hunk_counts() of one diff."""
    counts: dict[str, int] = {}
    path = None
    for line in diff.split("\n"):
        if line.startswith("+++ "):
            named = re.sub(r"^\+\+\+ ([ab]/)?", "", line.removesuffix("\r"))
            path = path if named == "/dev/null" else named
        elif line.startswith("@@") and path is not None:
            counts[path] = counts.get(path, 0) + 1
    return counts


def build_context(diff: str, changed: list[dict], related: list[dict], max_tokens: int = fixed.MAX_TOKENS, reserve: int = fixed.RESERVE_TOKENS, max_files: int = fixed.MAX_FILES) -> Package:
    """One change's package: rows of path, content, summary, hunks (changed; by default the diff's) or score (related), already ranked.

    Changed files by hunk count get full text (with the summary, if any), else their summary, else only the diff; lock
    files, generated and very large ones only the diff, without being reported as left out. A changed file that can't
    be read (content None) is full and empty; such a related one is passed over. Related files follow while they fit,
    smaller ones after those that do not. These are the tens of rows that a ranking's limit has left.
    """
    budget = max(max_tokens - reserve, 0)
    left = max(budget - tokens_of(diff), 0)
    out, spent, hunks = Package(), {"changed": 0, "related": 0}, hunks_of(diff)
    for f in sorted(changed, key=lambda f: -f.get("hunks", hunks.get(f["path"], 0))):
        content, summary = f.get("content") or "", f.get("summary")
        if non_reviewable(f["path"]) or len(content.encode()) > fixed.MAX_CHANGED_FILE_BYTES:
            tier, held, cost, summary = "diff_only", fixed.EXCLUDED_TEXT, tokens_of(fixed.EXCLUDED_TEXT), None
        elif (cost := tokens_of(content) + tokens_of(summary or "")) <= left:
            tier, held = "full", content
        elif summary is not None and (cost := tokens_of(summary)) <= left:
            tier, held, summary = "summary_only", fixed.SUMMARY_PREFIX + summary, None
            out.omitted.append({"path": f["path"], "reason": "content_degraded_to_summary"})
        else:
            tier, held, cost, summary = "diff_only", fixed.DIFF_ONLY_TEXT, tokens_of(fixed.DIFF_ONLY_TEXT), None
            out.omitted.append({"path": f["path"], "reason": "content_degraded_to_diff_only"})
        left = max(left - cost, 0)
        spent["changed"] += cost
        out.files.append({"path": f["path"], "tier": tier, "content": held, "summary": summary, "changed": True})
    taken = 0
    for f in related:
        need = tokens_of(f.get("content") or "")
        if taken >= max_files:
            out.omitted.append({"path": f["path"], "reason": "max_files_exceeded"})
        elif f.get("content") is None:
            continue
        elif need > left:
            out.omitted.append({"path": f["path"], "reason": "token_budget_exceeded"})
        else:
            left, taken = left - need, taken + 1
            spent["related"] += need
            out.files.append({"path": f["path"], "tier": "full", "content": f["content"], "summary": f.get("summary"), "changed": False, "score": f.get("score", 0.0)})
    tiers = [f["tier"] for f in out.files if f["changed"]]
    out.report = {"budget": budget, "diff_tokens": tokens_of(diff), "changed_tokens": spent["changed"], "related_tokens": spent["related"], "remaining": left, "files": len(out.files), "omitted": len(out.omitted)} | {t: tiers.count(t) for t in ("full", "summary_only", "diff_only")}
    return out


def truncate_to_budget(rows: DataFrame, budget: int, group: str, order: str = "line_no", line: str = "line") -> DataFrame:
    """Whole lines of each group until the byte budget ends; the first line always stays."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.octet_length(line) + 1).over(w)
    return rows.withColumn("_used", used).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where((F.col("_used") <= budget) | (F.col("_n") == 1)).drop("_used", "_n")


def truncate_diff(diff: str, token_budget: int) -> str | None:
    """Whole lines and a notice within the budget, one line at least; None for a diff that fits."""
    if tokens_of(diff) <= token_budget:
        return None
    room = max(token_budget - tokens_of(fixed.DIFF_NOTICE), 1) * fixed.BYTES_PER_TOKEN
    lines = [x.removesuffix("\r") for x in diff.split("\n")]
    lines = lines[:-1] if lines[-1] == "" else lines
    kept, used = "", 0
    for line in lines:
        used += len(line.encode()) + 1
        if used > room:
            break
        kept += line + "\n"
    if not kept.strip():
        kept += (lines[0] if lines else "") + "\n"
    return kept + fixed.DIFF_NOTICE


@dataclass
class Prompt:
    """A rendered prompt, the diff that it shows, and what was trimmed for it."""

    user: str
    tokens: int
    diff: str
    related_removed: int = 0
    degraded: int = 0
    diff_truncated: bool = False


def trim_to_prompt(package: Package, diff: str, render: Callable[[str, Package], str], budget: int, may_truncate: bool = False, system: str = "") -> Prompt:
    """Shrink the package until system and user prompt fit: drop the last related file; else degrade the largest full
    changed file; else, if allowed, cut the diff once; else give up."""
    out = Prompt("", 0, diff)
    while True:
        out.user = render(out.diff, package)
        out.tokens = tokens_of(system) + tokens_of(out.user)
        if out.tokens <= budget:
            return out
        related = [i for i, f in enumerate(package.files) if not f["changed"]]
        full = [(len(f["content"].encode()), i) for i, f in enumerate(package.files) if f["changed"] and f["tier"] == "full"]
        if related:
            package.files.pop(related[-1])
            out.related_removed += 1
        elif full:
            package.files[max(full)[1]].update(tier="diff_only", content=fixed.DIFF_ONLY_TEXT, summary=None)
            out.degraded += 1
        elif may_truncate and not out.diff_truncated and (shorter := truncate_diff(out.diff, max(tokens_of(out.diff) - (out.tokens - budget + fixed.DIFF_MARGIN), 0))) is not None:
            out.diff, out.diff_truncated = shorter, True
        else:
            return out


def fallback_targets(current: int) -> list[int]:
    """Smaller prompt sizes to try, largest first."""
    return [t for t in fixed.PROMPT_TARGETS if t < current]


def output_tokens(prompt_budget: int, reserve: int = fixed.RESERVE_TOKENS) -> int:
    """Tokens that a first answer may have."""
    return min(max(reserve, 1), max(prompt_budget, 1))


def fallback_output_tokens(prompt_budget: int, reserve: int = fixed.RESERVE_TOKENS) -> int:
    """Tokens that an answer to a smaller prompt may have."""
    return min(output_tokens(prompt_budget, reserve), max(prompt_budget // 4, fixed.MIN_OUTPUT_TOKENS))


def reduces_request(prompt: int, output: int, next_prompt: int, next_output: int) -> bool:
    return next_prompt < prompt or next_output < output


def pressure_step(state: dict, size: int, errors: int, elapsed: float) -> str | None:
    """Why summarising stops after this batch, or None; the time counts from the start, once pressure was seen."""
    state["total"] += errors
    if state["total"] and elapsed >= fixed.PRESSURE_SECONDS:
        return "time_budget"
    if not size or not errors:
        state["streak"] = 0
        return None
    if errors == size:
        return "full_batch"
    state["streak"] = state["streak"] + 1 if errors >= fixed.PRESSURE_RATIO * size else 0
    if state["streak"] >= fixed.PRESSURE_CONSECUTIVE:
        return "repeated_partial_batches"
    return "total_errors" if state["total"] >= fixed.PRESSURE_TOTAL else None


def pressure_stop(batches: list[tuple[int, int, float]]) -> str | None:
    """The first reason to stop in batches of (size, pressure errors, seconds since the start)."""
    state = {"total": 0, "streak": 0}
    return next(filter(None, (pressure_step(state, *b) for b in batches)), None)


def pressure_replay(batches: DataFrame, run: str = "run", order: str = "ord") -> DataFrame:
    """Logged batches (run, ord, size, errors, elapsed) with `stop`: the reason at the batch that ends its run, `over` behind it."""

    def step(state: dict, row: dict) -> tuple:
        if not state["over"] and (why := pressure_step(state, row["size"], row["errors"], row["elapsed"])):
            state["over"] = True
            return (why,)
        return ("over" if state["over"] else None,)

    return running(batches, run, [order], lambda: {"total": 0, "streak": 0, "over": False}, step, ["size", "errors", "elapsed"], "stop string")
