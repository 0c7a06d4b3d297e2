"""Recovery of structured answers from model output: balanced objects, a ladder of parsers, and clean-up of texts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import fixed

PARSED = "struct<summary:string,findings:array<struct<file:string,start_line:long,end_line:long,category:string,confidence:double,evidence:string,explanation:string,impact:string,suggestion:string>>,quality:string>"
_scan = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}]', re.S)


def balanced_objects(text: str) -> Iterator[str]:
    """Every outermost {...} whose braces balance, braces in strings apart."""
    depth, start = 0, 0
    for m in _scan.finditer(text):
        if m[0] == "{":
            if not depth:
                start = m.start()
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                yield text[start : m.end()]


def first_object(text: str) -> str | None:
    at = text.find("{")
    return None if at < 0 else next(balanced_objects(text[at:]), None)


def sanitize(text: str) -> str:
    """Without leaked reasoning at its start: the first sentence that is none, else what follows a phrase, else all."""
    text = text.strip()
    low = text.lower()
    if not low.startswith(fixed.REASONING_PHRASES):
        return text
    def after_marks(part: str) -> str:
        at = next((i for i, c in enumerate(part) if c.isalpha()), len(part))
        return part[at:].strip()

    for sentence in re.split(r"[.!?\n]", text):
        s = sentence.strip()
        if s and not s.lower().startswith(fixed.REASONING_PHRASES):
            return after_marks(s) + "."
    for phrase in fixed.REASONING_PHRASES:
        if phrase in low:
            rest = after_marks(text[low.index(phrase) + len(phrase) :])
            if len(rest.encode()) > 5:
                return rest
    return text


def _finding(item) -> dict | None:
    """An item as a finding, or None if a required field is missing, of another type, or of an unknown category."""
    if not isinstance(item, dict):
        return None
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0
    strings = [item.get(k) for k in ("file", "category", "evidence", "explanation", "impact")]
    end, confidence, suggestion = item.get("end_line"), item.get("confidence"), item.get("suggestion")
    if not all(isinstance(s, str) for s in strings) or strings[1] not in fixed.CATEGORIES or not whole(item.get("start_line")):
        return None
    if not (end is None or whole(end)) or isinstance(confidence, bool) or not isinstance(confidence, (int, float)) or not (suggestion is None or isinstance(suggestion, str)):
        return None
    clean = {k: sanitize(item[k]) for k in ("evidence", "explanation", "impact")} | {"suggestion": sanitize(suggestion) if suggestion else suggestion}
    return {"file": item["file"], "start_line": item["start_line"], "end_line": end, "category": item["category"], "confidence": float(confidence)} | clean


def _list(items: list) -> list[dict]:
    return [f for f in map(_finding, items) if f]


def _search(value) -> tuple[str, list[dict]] | None:
    """A finding list under one of the known keys, here or in any value (keys in sorted order), or a bare list of findings.

    A list counts only with a finding or a summary beside it; an outer summary goes before one further inside.
    """
    if isinstance(value, dict):
        summary = value["summary"] if isinstance(value.get("summary"), str) else ""
        for key in fixed.FINDING_KEYS:
            if isinstance(value.get(key), list) and ((found := _list(value[key])) or summary):
                return summary, found
        for key in sorted(value):
            if inner := _search(value[key]):
                return summary or inner[0], inner[1]
    elif isinstance(value, list) and (found := _list(value)):
        return "", found
    return None


def _load(text: str | None):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def parse_response(response: str) -> dict:
    """summary, findings and quality: strict, flexible, array, salvaged or malformed."""
    response = response.strip()
    part = first_object(response) or response
    value = _load(part)
    if isinstance(value, dict) and isinstance(value.get("summary"), str | None) and isinstance(value.get("findings"), list):
        found = _list(value["findings"])
        if len(found) == len(value["findings"]):
            return {"summary": value.get("summary") or "", "findings": found, "quality": "strict"}
    if value is not None and (search := _search(value)):
        return {"summary": search[0], "findings": search[1], "quality": "flexible"}
    opens, closes = part.find("["), part.rfind("]")
    items = _load(part[opens : closes + 1] if 0 <= opens < closes else part)
    if isinstance(items, list) and len(found := _list(items)) == len(items):
        return {"summary": "", "findings": found, "quality": "array"}
    key = response.find(fixed.FINDING_KEYS[0])
    at = response.find("[", key) if key >= 0 else -1
    found = _list([_load(o) for o in balanced_objects(response[max(at, 0) :])])
    return {"summary": "", "findings": found, "quality": "salvaged" if found else "malformed"}


def parse_responses(responses: Column) -> Column:
    """parse_response() of a text column; null counts as empty."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_response(t or "") for t in texts], columns=["summary", "findings", "quality"])

    return F.pandas_udf(run, PARSED)(responses)


def json_objects(texts: Column) -> Column:
    """The first balanced object of each text, or null."""

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: first_object(t) if t else None)

    return F.pandas_udf(run, "string")(texts)


def sanitized(texts: Column) -> Column:
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else sanitize(t))

    return F.pandas_udf(run, "string")(texts)


def batch_summaries(response: Column) -> Column:
    """map from name to summary of a batch answer; values that are no string or empty are left out."""
    whole = json_objects(response)
    typed = F.from_json(whole, "map<string,variant>")
    strings = F.map_filter(typed, lambda k, v: F.schema_of_variant(v) == "STRING")
    return F.map_filter(F.transform_values(strings, lambda k, v: F.trim(F.try_variant_get(v, "$", "string"))), lambda k, v: F.length(v) > 0)
