"""Scalar functions on text columns; all stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import fixed


def estimate_tokens(text: Column, per_token: int = fixed.BYTES_PER_TOKEN) -> Column:
    """UTF-8 bytes divided by `per_token`, rounded down."""
    return F.floor(F.octet_length(text) / per_token).cast("long")


def lines(text: Column) -> Column:
    """Lines of a text: cut at line feeds, one carriage return dropped at each end, no empty last line."""
    whole = F.regexp_replace(text, "\n\\z", "")
    cut = F.transform(F.split(whole, "\n"), lambda x: F.regexp_replace(x, "\r\\z", ""))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(cut)


def chunk_windows(content: Column, size: int = fixed.CHUNK_LINES, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    """Windows of `size` lines that start every size - overlap lines: array of (start_line, end_line, content).

    The last window may lie inside the one before it. If the step is not positive, the whole text is one window.
    """
    step = max(size - overlap, 0)

    def windows(held: Column) -> Column:
        n = F.size(held)
        if step == 0:
            one = F.array(F.struct(F.lit(1).alias("start_line"), n.alias("end_line"), F.array_join(held, "\n").alias("content")))
            return F.when(n > 0, one)
        each = F.transform(
            F.sequence(F.lit(0), n - 1, F.lit(step)),
            lambda s: F.struct((s + 1).alias("start_line"), F.least(s + size, n).alias("end_line"), F.array_join(F.slice(held, s + 1, size), "\n").alias("content")),
        )
        return F.when(n > 0, each)

    # the lines are bound to a variable, so that a text is cut once and not again for every window
    return F.get(F.transform(F.array(lines(content)), windows), F.lit(0))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normalize_evidence(text: Column) -> Column:
    """White space to single blanks, no blanks at the ends, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", ""))


def content_fingerprint(file: Column, category: Column, evidence: Column) -> Column:
    return F.substring(F.sha2(F.concat(file, category, normalize_evidence(evidence)), 256), 1, fixed.FINGERPRINT_LENGTH)


def line_fingerprint(file: Column, start: Column, end: Column, category: Column) -> Column:
    """An absent end line adds nothing."""
    return F.substring(F.sha2(F.concat(file, start.cast("string"), F.coalesce(end.cast("string"), F.lit("")), category), 256), 1, fixed.FINGERPRINT_LENGTH)


def diff_identifiers(diff: Column) -> Column:
    """Sorted different identifiers of over two bytes on the added lines of a unified diff."""
    added = F.filter(lines(diff), lambda x: x.startswith("+") & ~x.startswith("+++"))
    words = F.flatten(F.transform(added, lambda x: F.split(F.substring(x, 2, 1 << 30), r"[^\p{L}\p{N}_]+")))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) > 2) & w.rlike(r"^\p{L}"))))


def changed_paths(diff: Column) -> Column:
    """Sorted different paths of the new files of a unified diff; deleted files have none."""
    new = F.filter(lines(diff), lambda x: x.startswith("+++ b/"))
    return F.array_sort(F.array_distinct(F.transform(new, lambda x: F.substring(x, 7, 1 << 30))))


def code_candidates(evidence: Column) -> Column:
    """What an evidence text quotes as code: spans between back-ticks, and words with an underscore or a capital."""
    quoted = F.filter(F.transform(F.regexp_extract_all(evidence, F.lit("`([^`]*)`"), F.lit(1)), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: F.octet_length(x) >= 2)
    divider = r"(?U)[\s" + re.escape(fixed.WORD_DIVIDERS) + "]"
    words = F.transform(F.split(evidence, divider), lambda w: F.regexp_replace(w, "^`+|`+$", ""))
    words = F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*fixed.COMMON_WORDS) & w.rlike(r"_|\p{Lu}"))
    return F.array_sort(F.array_distinct(F.concat(quoted, words)))


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    return text.rlike("|".join(re.escape(p).replace("\\ ", " ") for p in phrases))


def is_self_dismissed(explanation: Column, impact: Column) -> Column:
    """Whether a finding takes itself back. A null text counts as empty."""
    body = F.concat(F.lower(F.coalesce(explanation, F.lit(""))), F.lit(" "), F.lower(F.coalesce(impact, F.lit(""))))
    minimal = body.contains(fixed.MINIMAL_SECURITY) | (body.contains(fixed.MINIMAL) & ~body.contains(fixed.MINIMAL_QUALIFIER))
    return contains_any(body, fixed.DISMISSAL_PHRASES) | minimal


def claims_findings(text: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), "^ | $", "")
    return ~contains_any(body, fixed.NO_CLAIM_PHRASES) & contains_any(body, fixed.CLAIM_PHRASES)


def has_reasoning(text: Column) -> Column:
    return contains_any(F.lower(text), fixed.REASONING_PHRASES)


def is_non_reviewable(path: Column) -> Column:
    """Lock files, minified files and bundles."""
    name = F.element_at(F.split(path, "/"), -1)
    out = name.isin(*fixed.NON_REVIEWABLE_NAMES)
    for suffix in fixed.NON_REVIEWABLE_SUFFIXES:
        out = out | path.endswith(suffix)
    return out


def line_slice(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, both included, the end clamped); null if the start lies beyond the text."""
    held = lines(content)
    return F.when((start >= 1) & (start <= F.size(held)), F.array_join(F.slice(held, start, F.least(end, F.size(held)) - start + 1), "\n"))


def percent(value: Column) -> Column:
    return F.format_string("%.1f%%", value * 100)


def truncate_chars(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def truncate_bytes(text: Column, most: int) -> Column:
    """A text of over `most` UTF-8 bytes up to the character that holds the byte behind them; never cut inside a character."""
    raw = F.encode(text, "UTF-8")
    whole = [F.try_validate_utf8(F.substring(raw, 1, most + k).cast("string")) for k in (1, 2, 3, 4)]
    return F.when(F.octet_length(text) > most, F.coalesce(*whole)).otherwise(text)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def inside_root(path: Column) -> Column:
    """Whether a relative path, its dots resolved, stays below the root and names something in it; null for a null path."""
    step = lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    walked = F.aggregate(F.split(path, "/"), start, lambda a, p: F.struct((a["depth"] + step(p)).alias("depth"), F.least(a["least"], a["depth"] + step(p)).alias("least")))
    return ~path.startswith("/") & (walked["least"] >= 0) & (walked["depth"] > 0)


def language_of(path: Column) -> Column:
    """Language by extension, null for others."""
    out = F.lit(None).cast("string")
    for language, endings in (("rust", ("rs",)), ("typescript", ("ts", "tsx")), ("python", ("py",)), ("java", ("java",))):
        out = F.when(extension(path).isin(*endings), F.lit(language)).otherwise(out)
    return out


def is_likely_text(content: Column) -> Column:
    """No zero byte among the first bytes of a binary column."""
    return ~F.contains(F.substring(content, 1, fixed.TEXT_SAMPLE_BYTES), F.lit(bytearray(b"\0")))


def failure_kind(status: Column, body: Column) -> Column:
    """rate_limited, provider_pressure or server_error, of a provider's answer that is worth another try."""
    pressed = status.isin(*fixed.PRESSURE_STATUSES) | contains_any(F.lower(F.coalesce(body, F.lit(""))), fixed.PRESSURE_PHRASES)
    return F.when(status == 429, "rate_limited").when(pressed, "provider_pressure").otherwise("server_error")


def load_failure_kind(message: Column) -> Column:
    """rate_limited or other, of why an embedding model could not be loaded."""
    return F.when(contains_any(F.lower(F.coalesce(message, F.lit(""))), fixed.RATE_LIMIT_PHRASES), "rate_limited").otherwise("other")


def experiment_name(sha: Column, timestamp: Column) -> Column:
    """Short commit id and the time of an evaluation, from any of three ISO-8601 forms."""
    when = F.coalesce(*(F.try_to_timestamp(timestamp, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss")), F.current_timestamp())
    return F.concat_ws("-", F.substring(sha, 1, 7), F.date_format(when, "yyyyMMdd-HHmmss"))
