"""Whole runs: a review of one change, and an evaluation over fixtures."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import jsonx, text
from tessera.operators import budget, evaluate, findings, report, retrieval, vector
from tessera.plans import embed
from tessera.plans.summarise import Stats, summarise
from tessera.sources.connectors import ChatModel, CodeHost, ProviderError, complete_column
from tessera.sources.store import Store

REPAIR = 'Turn the review below into one JSON object {"summary": ..., "findings": [...]} and add nothing that it does not say.'
FINDING = "ord long, file string, start_line int, end_line int, category string, confidence double, evidence string, explanation string, impact string, suggestion string"


@dataclass
class Review:
    findings: DataFrame
    outcome: str
    reason: str | None = None
    notes: list[str] = field(default_factory=list)


def as_findings(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([(i, *(r[c] for c in ("file", "start_line", "end_line", "category", "confidence", "evidence", "explanation", "impact", "suggestion"))) for i, r in enumerate(rows)], FINDING)


def ask(model: ChatModel, system: str, render, package: budget.Package, diff: str, prompt_budget: int, reserve: int = fixed.RESERVE_TOKENS) -> tuple[str, bool, list[str]]:
    """The model's answer, whether something was trimmed, and notes for the reader.

    Under pressure prompt and answer shrink step by step; a step that makes neither smaller is passed over. Only these
    steps may cut the diff.
    """
    shown = budget.trim_to_prompt(package, diff, render, prompt_budget, False, system)
    first, output = shown.tokens, budget.output_tokens(prompt_budget, reserve)
    trimmed = bool(shown.related_removed or shown.degraded)
    try:
        return model.complete(system, shown.user, output), trimmed, []
    except ProviderError as e:
        if not e.reducible:
            raise
        last = e
    for target in budget.fallback_targets(first):
        before, smaller = shown.tokens, budget.fallback_output_tokens(target, reserve)
        shown = budget.trim_to_prompt(package, shown.diff, render, target, True, system)
        if not budget.reduces_request(before, output, shown.tokens, smaller):
            continue
        try:
            answer = model.complete(system, shown.user, smaller)
        except ProviderError as e:
            if not e.reducible:
                raise
            last, output = e, smaller
            continue
        note = f"The context was reduced from {first} to {shown.tokens} tokens after provider pressure."
        return answer, True, [note + " The diff was cut to fit." if shown.diff_truncated else note]
    raise last


def review(spark: SparkSession, model: ChatModel, diff: str, package: budget.Package, contents: DataFrame, prompt_budget: int = fixed.MAX_TOKENS - fixed.RESERVE_TOKENS, conventions: str | None = None) -> Review:
    """Ask, parse, repair once if nothing usable came, then filter, verify, threshold and fingerprint, in this order."""
    answer, trimmed, notes = ask(model, report.system_prompt(conventions), report.user_prompt, package, diff, prompt_budget)
    parsed = jsonx.parse_response(answer)
    repaired = repaired_text = None
    if not parsed["findings"] and (parsed["quality"] in ("malformed", "salvaged") or any(p in answer.lower() for p in fixed.REASONING_PHRASES)):
        repaired_text = model.complete(REPAIR, answer)
        repaired = jsonx.parse_response(repaired_text)
    final = repaired or parsed
    one = spark.createDataFrame([(bool(final["findings"]), parsed["summary"], parsed["quality"], answer, *((repaired["summary"], repaired["quality"], repaired_text) if repaired else (None, None, None)))], "has boolean, summary string, quality string, response string, rs string, rq string, rr string")
    reason = one.select(findings.empty_review_reason(F.col("has"), F.col("summary"), F.col("quality"), F.col("response"), F.col("rs"), F.col("rq"), F.col("rr")).alias("r")).first()["r"]
    kept = findings.fingerprints(findings.threshold(findings.verify(findings.apply_filters(as_findings(spark, final["findings"])), contents)))
    outcome = "inconclusive" if reason else "findings" if not kept.isEmpty() else "limited_clean" if trimmed or package.omitted else "clean"
    return Review(kept, outcome, reason, notes)


def changed_and_related(changed: DataFrame, related: DataFrame) -> DataFrame:
    """(path, ord): changed paths (path, ord), then the related ones (path, score) that are not among them, best first."""
    both = changed.select("path", F.lit(0).alias("side"), F.struct(F.col("ord").cast("double").alias("k"), "path").alias("by"))
    both = both.unionByName(related.select("path", F.lit(1).alias("side"), F.struct((-F.col("score")).alias("k"), "path").alias("by")))
    first = both.groupBy("path").agg(F.min(F.struct("side", "by")).alias("at"))
    return first.select("path", F.row_number().over(Window.orderBy("at")).alias("ord"))  # one change's paths


def review_change(spark: SparkSession, model: ChatModel, store: Store, diff: str, contents: DataFrame, max_files: int = fixed.MAX_FILES, max_tokens: int = fixed.MAX_TOKENS, reserve: int = fixed.RESERVE_TOKENS, conventions: str | None = None, embedder: vector.Embedder | None = None, summary_model: ChatModel | None = None, weights: dict[str, float] | None = None) -> Review:
    """A review that starts from a diff, the stored graph and the files' texts (path, content): related files are retrieved,
    packed into the budget and shown with the change.

    With a summary_model, changed files without a summary get one first, and after the ranking the related files that would
    be shown. With an embedder, the vectors that stored summaries and chunks lack are made before the ranking, so all four kinds
    of evidence count; without one, only structure and names do.
    """
    one = spark.createDataFrame([(diff,)], "diff string")
    paths = one.select(F.posexplode(text.changed_paths(F.col("diff"))).alias("ord", "path"))
    names = one.select(F.explode(text.diff_identifiers(F.col("diff"))).alias("name"))
    changed_paths = [r["path"] for r in paths.orderBy("ord").collect()]  # one change's
    files = store.read("files")
    changed = files.join(paths, "path").select("id", "path")
    if summary_model:
        summarise_missing(store, contents, summary_model, changed_paths)
    vectors = summaries = chunks = None
    if embedder:
        embed.embed_store(store, embedder)
        vectors = embed.changed_vectors(store, changed, embedder)
        summaries, chunks = embed.stored_vectors(store)
    pairs = store.read("cochange").select(F.col("file_id_a").alias("file_a"), F.col("file_id_b").alias("file_b"), "correlation", "commit_count")
    ranked = retrieval.retrieve(changed, files, store.read("imports"), pairs, store.read("symbols"), store.read("refs"), names, summaries, chunks, vectors, weights)
    ranked = ranked.join(paths, "path", "left_anti").orderBy(F.desc("score"), "path")
    related = [r.asDict() for r in ranked.select("path", "score").limit(2 * max_files).collect()]
    shown = list(dict.fromkeys([*changed_paths, *(r["path"] for r in related)]))
    if summary_model:
        summarise_missing(store, contents, summary_model, shown)
    told = files.where(F.col("path").isin(shown)).join(store.read("summaries").where("level = 'file'").select(F.col("file_id").alias("id"), "summary"), "id").select("path", "summary")
    texts = contents.where(F.col("path").isin(shown)).select("path", "content")
    held = {r["path"]: r for r in texts.join(told, "path", "full").select("path", "content", "summary").collect()}  # bounded by max_files

    def row(path: str, **more) -> dict:
        r = held.get(path)
        return {"path": path, "content": r["content"] if r else None, "summary": r["summary"] if r else None} | more

    package = budget.build_context(diff, [row(p) for p in changed_paths], [row(r["path"], score=r["score"]) for r in related], max_tokens, reserve, max_files)
    return review(spark, model, diff, package, contents, max_tokens - reserve, conventions)


def summarise_missing(store: Store, contents: DataFrame, model: ChatModel, paths: list[str]) -> Stats | None:
    """Summaries of the indexed files among the paths that have none; None if all have one."""
    files = store.read("files").where(F.col("path").isin(paths)).select("id", "path")
    have = store.read("summaries").where("level = 'file'").select(F.col("file_id").alias("id"))
    lacking = [r["path"] for r in files.join(have, "id", "left_anti").select("path").collect()]  # bounded by the paths
    if not lacking:
        return None
    rows = store.spark.createDataFrame([(p,) for p in lacking], "path string")
    return summarise(store, contents.where(F.col("path").isin(lacking)), model, paths=rows)


def publish(host: CodeHost, result: Review, changed: list[str], counts: dict[str, int]) -> None:
    """Posts the findings and a summary, and resolves earlier findings that are gone."""
    spark = result.findings.sparkSession
    rows = [r.asDict() for r in result.findings.withColumn("body", report.finding_body()).collect()]  # one review's
    prior = spark.createDataFrame([(p.get("fp_id"), p.get("line_id")) for p in host.prior_fingerprints()], "fp_id string, line_id string")
    host.resolve_stale([r.asDict() for r in findings.stale(prior, result.findings).collect()])
    host.post_findings(rows)
    host.post_summary(report.summary_body(report.review_summary(result.outcome, changed, counts, len(rows), result.outcome == "limited_clean")))


def run_evaluation(fixtures: DataFrame, model: ChatModel, history: DataFrame | None = None, concurrency: int = 3) -> tuple[DataFrame, DataFrame]:
    """Results of each fixture and the gated total.

    fixtures: name, diff, files (map of path to content), conventions, expected_findings. All files are shown in full;
    there is no retrieval. A failed call counts as no findings and makes the fixture inconclusive.
    """
    spark = fixtures.sparkSession
    advice = evaluate.guidance(history).first()["advice"] if history is not None else None
    shown = F.array_join(F.transform(F.map_entries("files"), lambda e: F.concat(F.lit("### "), e["key"], F.lit("\n```\n"), report.numbered_lines(e["value"]), F.lit("\n```"))), "\n\n")
    prompts = fixtures.select(F.xxhash64("name").alias("id"), F.concat(F.lit(report.system_prompt(guidance=advice)), F.coalesce(F.concat(F.lit("\n\n## Conventions\n"), "conventions"), F.lit(""))).alias("system"), F.concat(F.lit("## Diff\n"), "diff", F.lit("\n\n## Changed files\n"), shown).alias("user"))
    answers = complete_column(prompts, model, concurrency).withColumn("p", jsonx.parse_responses(F.col("response"))).persist()
    names = fixtures.select(F.xxhash64("name").alias("id"), F.col("name").alias("fixture"), "expected_findings")
    joined = names.join(answers, "id")
    raw = joined.select("fixture", F.posexplode("p.findings").alias("ord", "f")).select("fixture", F.col("ord").cast("long"), "f.*")
    kept = findings.apply_filters(raw.withColumn("file", F.concat_ws("\0", "fixture", "file"))).withColumn("file", F.element_at(F.split("file", "\0"), 2))
    expected = names.select("fixture", F.posexplode("expected_findings").alias("ord", "e")).select("fixture", F.col("ord").cast("long"), "e.file", "e.start_line", "e.category", F.col("e.acceptable_categories").alias("acceptable"))
    reason = findings.empty_review_reason(F.size("p.findings") > 0, F.col("p.summary"), F.col("p.quality"), F.col("response"))
    state = joined.select("fixture", (F.col("error").isNotNull() | reason.isNotNull()).alias("inconclusive"))
    results = evaluate.fixture_results(names.select("fixture"), expected, kept.select("fixture", "file", "ord", "start_line", "category")).join(state, "fixture")
    total = evaluate.gates(evaluate.aggregate(results).join(results.agg(F.count_if("inconclusive").alias("inconclusive"))), F.col("inconclusive"))
    return results, total


def experiment_events(results: DataFrame, model: str) -> DataFrame:
    """One event for each fixture and one for all, as a dashboard takes them: name, scores and counts."""
    each = evaluate.rates(results).select(F.col("fixture").alias("name"), F.struct("precision", "recall", "f1").alias("scores"), F.struct("tp", "fp", "fn").alias("counts"))
    whole = evaluate.aggregate(results).select(F.lit("all").alias("name"), F.struct("precision", "recall", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0).alias("f1")).alias("scores"), F.struct("tp", "fp", "fn").alias("counts"))
    return each.unionByName(whole).withColumn("model", F.lit(model))


def record(results: DataFrame, total: DataFrame, sha: str) -> DataFrame:
    """One history row of an evaluation."""
    each = results.agg(F.array_sort(F.collect_list(F.struct(F.col("fixture").alias("name"), "expected", "actual", "tp", "fp", F.col("fn").alias("fn_count"), "inconclusive", F.lit(None).cast("string").alias("error")))).alias("per_fixture"), F.count("*").alias("fixture_count"))
    return total.join(each).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(sha).alias("git_sha"), "fixture_count", "precision", "recall", F.col("noise").alias("noise_rate"), "gates_passed", "per_fixture")

