"""SARIF, Markdown, prompts and comment bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import text

MARK, ID_MARK, LINE_MARK, MARK_END = "<!-- tessera -->", "<!-- tessera-id:", "<!-- tessera-line:", "-->"


def sarif_level(confidence: Column) -> Column:
    return F.when(confidence >= fixed.SARIF_ERROR, "error").when(confidence >= fixed.SARIF_WARNING, "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    """Adds `result`: a SARIF result struct for each finding; what is null is left out of its JSON."""
    region = F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    location = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    prints = F.when(F.col("fp_id").isNotNull(), F.struct(F.col("fp_id").alias("contentId"), F.col("line_id").alias("lineId")))
    fix = F.when(F.col("suggestion").isNotNull(), F.struct(F.col("suggestion").alias("suggestion")))
    result = F.struct(F.col("category").alias("ruleId"), sarif_level(F.col("confidence")).alias("level"), F.struct(F.col("explanation").alias("text")).alias("message"), F.array(location).alias("locations"), prints.alias("fingerprints"), fix.alias("properties"))
    return findings.withColumn("result", result)


def sarif(findings: DataFrame) -> DataFrame:
    """One row with a SARIF 2.1.0 document; findings of one review."""
    rules = F.array(*(F.struct(F.lit(c).alias("id"), F.lit(c.capitalize()).alias("name"), F.struct(F.lit(f"{c} finding").alias("text")).alias("shortDescription")) for c in fixed.CATEGORIES))
    driver = F.struct(F.struct(F.lit("tessera").alias("name"), rules.alias("rules")).alias("driver"))
    results = F.transform(F.array_sort(F.collect_list(F.struct("ord", "result"))), lambda x: x["result"])
    return sarif_results(findings).agg(results.alias("results")).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), F.col("results"))).alias("runs"))).alias("sarif"))


def write_findings(findings: DataFrame, path: str, form: str = "sarif") -> bool:
    """Writes a review's findings to a folder as one SARIF document or as JSON lines; nothing, and False, for none."""
    if findings.isEmpty():
        return False
    rows = sarif(findings) if form == "sarif" else findings.select(F.to_json(F.struct(*findings.columns)).alias("json"))
    rows.coalesce(1).write.mode("overwrite").text(path)
    return True


def finding_body() -> Column:
    """Markdown of one finding: a heading line, what is wrong, what it leads to, the quoted code and a way out; ids in comments at the end."""
    ids = F.when(F.col("fp_id").isNotNull(), F.concat(F.lit("\n" + ID_MARK), F.col("fp_id"), F.lit(MARK_END + LINE_MARK), F.coalesce("line_id", F.lit("")), F.lit(MARK_END))).otherwise("")
    way = F.when(F.col("suggestion").isNotNull(), F.concat(F.lit("\n- Suggestion: "), F.col("suggestion"))).otherwise("")
    head = F.format_string("%s\n### %s, %.0f of 100 sure\n\n", F.lit(MARK), F.initcap("category"), F.col("confidence") * 100)
    return F.concat(head, F.col("explanation"), F.lit("\n\n- Leads to: "), F.col("impact"), way, F.lit("\n\n~~~\n"), F.col("evidence"), F.lit("\n~~~"), ids)


def marker_value(body: Column, mark: str) -> Column:
    """What stands between a mark and its end, trimmed; null if it is absent or empty."""
    value = F.trim(F.regexp_extract(body, mark.replace("-", "\\-") + r"((?s).*?)\-\->", 1))
    return F.when(value != "", value)


def resolved_body() -> str:
    return f"{MARK}\n\n**Resolved**: the change no longer has this issue."


def summary_body(summary: str) -> str:
    return f"{MARK}\n\n{summary}"


def diff_header(old: str, new: str, diff: str) -> str:
    return f"--- a/{old}\n+++ b/{new}\n{diff}\n"


def numbered_lines(content: Column) -> Column:
    """Lines with their numbers from 1, as a prompt shows them."""
    return F.array_join(F.transform(text.lines(content), lambda x, i: F.format_string("%4d | %s", i + 1, x)), "\n")


def system_prompt(conventions: str | None = None, guidance: str | None = None, suppress_style: bool = True) -> str:
    parts = ["You review a code change. Report only defects that the change introduces, each with quoted evidence and its impact."]
    if suppress_style:
        parts.append("Leave out style, unless it breaks a stated convention of the project.")
    if conventions:
        parts.append(f"## Conventions\n{conventions}\nReport breaches as category convention.")
    if guidance:
        parts.append(f"## From recent evaluations\n{guidance}")
    parts.append('Answer with one JSON object: {"summary": string, "findings": [{"file", "start_line", "end_line", "category", "confidence", "evidence", "explanation", "impact", "suggestion"}]}.')
    return "\n\n".join(parts)


def user_prompt(diff: str, package, title: str = "") -> str:
    """Diff, changed files with numbered lines, related files. Line numbers start at 1."""
    def shown(f: dict) -> str:
        if f["tier"] == "diff_only":
            return f["content"]
        body = f["content"].split("\n") if f["tier"] == "full" else [f["content"]]
        return "```\n" + "\n".join(f"{i:>4} | {x}" if f["tier"] == "full" else x for i, x in enumerate(body, 1)) + "\n```"

    parts = [f"Change: {title}"] if title else []
    parts.append(f"## Diff\n```diff\n{diff}\n```")
    for head, changed in (("## Changed files", True), ("## Related files", False)):
        files = [f for f in package.files if f["changed"] == changed]
        if files:
            parts.append(head)
            parts += [f"### {f['path']}" + ("" if changed else f" (relevance: {f.get('score', 0):.2f})") + f"\n{shown(f)}" for f in files]
    return "\n\n".join(parts)


def symbol_prompt(path: Column, name: Column, kind: Column, body: Column) -> Column:
    return F.format_string("Summarise in one or two sentences what the %s %s in %s does.\n\n%s", kind, name, path, body)


def batch_prompt(path: Column, symbols: Column) -> Column:
    """symbols: array of (name, kind, body)."""
    items = F.array_join(F.transform(symbols, lambda s: F.format_string("## %s (%s)\n%s", s["name"], s["kind"], s["body"])), "\n\n")
    return F.format_string("Summarise each of these symbols of %s. Answer with a JSON object from name to summary.\n\n%s", path, items)


def file_prompt(path: Column, children: Column) -> Column:
    """children: array of (name, summary)."""
    items = F.array_join(F.transform(children, lambda c: F.format_string("- %s: %s", c["name"], c["summary"])), "\n")
    return F.format_string("Summarise in two sentences the file %s, which holds:\n%s", path, items)


def review_summary(outcome: str, changed: list[str], counts: dict[str, int], findings: int, trimmed: bool) -> str:
    """Markdown of a whole review; the retrieval counts are shown only if nothing was trimmed."""
    said = {"clean": "No issues found.", "limited_clean": "No issues found in the context that fitted.", "findings": f"{findings} finding(s).", "inconclusive": "The review was inconclusive."}
    parts = [f"**{said[outcome]}**", "Changed files:\n" + "\n".join(f"- `{p}`" for p in changed)]
    if not trimmed:
        parts.append("Related files: " + ", ".join(f"{k} {v}" for k, v in counts.items()))
    return "\n\n".join(parts)
