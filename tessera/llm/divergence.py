"""Source divergence audit: which terms, and which other sources, set the sources of a language apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Shares are counted in parts of UNIT; counts are smoothed by SMOOTH.
UNIT, SMOOTH = 1_000_000_000, 2
#: Rows of a bucket of postings; parts that the groups of a language are cut into where they meet the counts of others.
BUCKET_ROWS, SALTS = 200_000, 16
#: Pair sums held before equal pairs are added up.
HELD_PAIRS = 2_000_000

COUNTS = "lang string, source string, term string, n long, docs long"
FOUND = "lang string, source string, part string, item string, value long"


def letters(buf: np.ndarray) -> np.ndarray:
    """The bytes of terms: ASCII letters and all bytes of other characters."""
    return ((buf | 32) - np.uint8(97) < 26) | (buf >= 128)


def terms_of(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of the texts one after another, A-Z in lower case, and the number of the text that each stands in."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    mask = letters(buf)
    edge = np.diff(np.r_[False, mask].view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    data = buf[mask]
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    ends_of = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return coded, np.searchsorted(ends_of, starts, "right")


def counted(docs: DataFrame) -> DataFrame:
    """COUNTS rows: occurrences and documents of each term by (lang, source). A null term's row stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            number = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
            held, group = list(number), np.fromiter((number[p] for p in pairs), np.int64, len(pairs))
            for at, some in common.chunks(np.arange(len(texts)), texts, 8_000_000):
                coded, text = terms_of(some)
                code = coded.indices.to_numpy().astype(np.int64)
                distinct = max(1, len(coded.dictionary))
                in_text, n = np.unique(text * distinct + code, return_counts=True)
                key = group[at][in_text // distinct] * distinct + in_text % distinct
                keys, back, documents = np.unique(key, return_inverse=True, return_counts=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, back, n)
                here, of_group = np.unique(group[at], return_counts=True)
                groups = np.r_[keys // distinct, here]
                terms = pa.concat_arrays([coded.dictionary.take(pa.array(keys % distinct)).cast(pa.large_string()), pa.nulls(len(here), pa.large_string())]).cast(pa.string())
                yield pa.record_batch([pa.array([held[g][0] for g in groups]), pa.array([held[g][1] for g in groups]), terms, pa.array(np.r_[total, np.zeros(len(here), np.int64)]), pa.array(np.r_[documents, of_group])], names=["lang", "source", "term", "n", "docs"])

    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return docs.mapInArrow(common.tidy_rows(run), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n, total, terms):
    """Smoothed share of a term, in parts of UNIT, from 1: whole numbers, as columns or arrays.

    UNIT times a count can leave a long, so columns multiply as decimals and arrays divide three digits at a time.
    """
    if isinstance(n, Column):
        return F.lit(1) + F.call_function("div", F.lit(UNIT) * (n + SMOOTH).cast("decimal(19,0)"), (total + F.lit(SMOOTH) * terms).cast("decimal(19,0)"))
    below = total + SMOOTH * terms
    whole, rest = np.divmod(n + SMOOTH, below)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digits
    return 1 + whole


def divergence(p, q):
    """floor((p - q)**2 / (p + q)); it grows with p and falls with q where p > q."""
    if isinstance(p, Column):
        return F.call_function("div", (p - q) * (p - q), p + q)
    return (p - q) * (p - q) // (p + q)


def search_terms(p: np.ndarray, q: np.ndarray, count: np.ndarray, names: list[str], k: int) -> tuple[list[tuple[int, str]], int]:
    """The k terms with p > q whose divergence is largest, ties to the smaller name, and how many terms were looked at.

    Terms lie in buckets by the length of their count in bits. The largest p and the smallest q of a bucket bound its
    terms; buckets are opened by falling bound until the next bound is strictly below the k-th value found.
    """
    if not len(p):
        return [], 0
    bucket = np.frexp(count.astype(np.float64))[1]
    order = np.argsort(bucket, kind="stable")
    starts, ends = common.runs_of(bucket[order])
    most, least = np.maximum.reduceat(p[order], starts), np.minimum.reduceat(q[order], starts)
    bound = np.where(most > least, divergence(most, least), -1)
    best: list[tuple[int, str]] = []
    opened = 0
    for b in np.argsort(-bound, kind="stable"):
        if bound[b] < 0 or len(best) == k and bound[b] < -best[-1][0]:
            break
        at = order[starts[b] : ends[b]]
        opened += len(at)
        at = at[p[at] > q[at]]
        value = divergence(p[at], q[at])
        if len(at) > k:
            near = value >= np.partition(value, len(value) - k)[len(value) - k]  # ties of the k-th stay
            at, value = at[near], value[near]
        best = sorted([*best, *((-int(v), names[i]) for v, i in zip(value, at, strict=True))])[:k]
    return [(-v, name) for v, name in best], opened


class PairSums:
    """Exact sums by (language, source, source), all as numbers."""

    def __init__(self, sources: int):
        self.sources, self.keys, self.values, self.held = sources, [], [], 0

    def add(self, lang: np.ndarray, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        self.keys.append((lang * self.sources + a) * self.sources + b)
        self.values.append(value)
        self.held += len(value)
        if self.held > HELD_PAIRS:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.keys:
            keys, values = np.concatenate(self.keys), np.concatenate(self.values)
            order = np.argsort(keys, kind="stable")
            starts, _ = common.runs_of(keys[order])
            self.keys, self.values = [keys[order][starts]], [np.add.reduceat(values[order], starts) if len(starts) else values]
            self.held = len(starts)
        return (self.keys[0], self.values[0]) if self.keys else (np.zeros(0, np.int64),) * 2


def shared_terms(lang: np.ndarray, term: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray, sources: int) -> PairSums:
    """For each pair of sources, over the terms that both hold: f(pa, pb) - f(pa, b without) - f(a without, pb) + f(both without).

    The rows of a term follow each other; a row meets the next of its posting, then the one after, and so on, all terms at
    once, and sums are added up by pair as they come.
    """
    sums, at = PairSums(sources), np.arange(len(term))
    step = 1
    while len(at := at[at + step < len(term)]) and len(at := at[term[at] == term[at + step]]):
        i, j = at, at + step
        value = divergence(p[i], p[j]) - divergence(p[i], p0[j]) - divergence(p0[i], p[j]) + divergence(p0[i], p0[j])
        sums.add(lang[i], np.minimum(source[i], source[j]), np.maximum(source[i], source[j]), value)
        step += 1
    return sums


def audit(docs: DataFrame, k: int = 10, least_docs: int = 10) -> DataFrame:
    """What sets each (lang, source) group apart: every other source of its lang by divergence, and its k most typical terms.

    docs: text, lang, source (null: ''); other columns are ignored; every row is a document, repeated ones too. Terms are
    runs of ASCII letters and of characters beyond ASCII, A-Z in lower case. A lang keeps the terms in at least
    `least_docs` of its documents. Returns lang, source, part, item, value, rank. Part 'pair': item is another source, value
    the sum over all kept terms of floor((p - q)**2 / (p + q)) of the two smoothed shares; all sources. Part 'term': item
    is a term whose share p in the group is above the share q in the lang; the k largest. Ranks go by value, then item. All
    numbers are whole. Groups without terms have pairs only, a lang of one source has none; an empty table gives no rows.

    Terms are counted by batch, then by group, then put in postings by term; buckets of postings find their best terms
    (search_terms) and the pair sums over shared terms (shared_terms). What a term adds to a pair of which one
    source lacks it depends on its count alone, so a histogram of counts meets the other sources.
    """
    counts = common.checkpoint(counted(docs))
    of_term = Window.partitionBy("lang", "term")
    kept = counts.where("term IS NOT NULL").withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term), "lead": (F.min("source").over(of_term) == F.col("source")).cast("long")})
    kept = common.checkpoint(kept.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "lead"))
    langs = kept.groupBy("lang").agg(F.sum("lead").alias("lang_terms"), F.sum("n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    zero = F.lit(0).cast("long")
    groups = counts.where("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = common.checkpoint(groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_terms", "lang_total"))))

    @common.tidy_group
    def bucket(part: pa.Table) -> pa.Table:
        part = part.sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")])
        lang, source, term = (part.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source", "term"))
        n, total, lang_n, lang_total, v = (part.column(c).to_numpy() for c in ("n", "total", "lang_n", "lang_total", "lang_terms"))
        of_lang, of_source, of_term = (d.indices.to_numpy().astype(np.int64) for d in (lang, source, term))
        langs, sources, terms = lang.dictionary.to_pylist(), source.dictionary.to_pylist(), term.dictionary.to_pylist()
        p, p0, q = share(n, total, v), share(np.zeros_like(n), total, v), share(lang_n, lang_total, v)
        rows: list[tuple] = []
        posting = of_lang * len(terms) + of_term
        keys, values = shared_terms(of_lang, posting, of_source, p, p0, len(sources)).merge()
        for key, value in zip(keys.tolist(), values.tolist(), strict=True):
            rest, b = divmod(key, len(sources))
            at, a = divmod(rest, len(sources))
            rows += [(langs[at], sources[a], "pair", sources[b], value), (langs[at], sources[b], "pair", sources[a], value)]
        group = of_lang * len(sources) + of_source
        order = np.argsort(group, kind="stable")
        for s, e in zip(*common.runs_of(group[order]), strict=True):
            at = order[s:e]
            best, _ = search_terms(p[at], q[at], n[at], [terms[i] for i in of_term[at]], k)
            rows += [(langs[of_lang[at[0]]], sources[of_source[at[0]]], "term", name, value) for value, name in best]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.table({c: pa.array(x, pa.int64() if c == "value" else pa.string()) for c, x in zip(("lang", "source", "part", "item", "value"), columns, strict=True)})

    buckets = max(8, kept.count() // BUCKET_ROWS)
    rows = kept.join(groups.drop("terms"), ["lang", "source"]).withColumn("bucket", F.pmod(F.xxhash64("lang", "term"), F.lit(buckets)).cast("int"))
    found = common.checkpoint(rows.select("bucket", "lang", "source", "term", "n", "total", "lang_n", "lang_total", "lang_terms").groupBy("bucket").applyInArrow(bucket, FOUND))

    salted = F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")
    others = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"), F.col("terms").alias("item_terms"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    meets = lambda one: one.withColumn("salt", salted).join(others, ["lang", "salt"]).where("source <> item")
    lacking = share(zero, F.col("item_total"), F.col("lang_terms"))
    histogram = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("many")).join(groups.select("lang", "source", "total", "lang_terms"), ["lang", "source"])
    alone = meets(histogram).groupBy("lang", "source", "item").agg(F.sum(F.col("many") * divergence(share(F.col("n"), F.col("total"), F.col("lang_terms")), lacking)).alias("value"))
    neither = F.when(F.col("lang_terms") > 0, (F.col("lang_terms") - F.col("terms") - F.col("item_terms")) * divergence(share(zero, F.col("total"), F.col("lang_terms")), lacking)).otherwise(0)
    pairs = [
        meets(groups).select("lang", "source", "item", neither.alias("value")),
        alone,
        alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"),
        found.where("part = 'pair'").select("lang", "source", "item", "value"),
    ]
    every = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).unionByName(pairs[3]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    out = every.select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(found.where("part = 'term'"))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= k)).select("lang", "source", "part", "item", "value", "rank")
