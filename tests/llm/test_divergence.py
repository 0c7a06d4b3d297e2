"""The divergence audit against plain dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, value string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, k=10, least=10):
    groups, counts, docs = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, N: 1 + 1_000_000_000 * (n + 2) // (N + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        of_lang = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(of_lang[t], sum(of_lang.values())) for t in kept}
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:k]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "naïve", "Ünder", "ünder", "日本", "x1y", "don't", "ﬁn", "a_b"] + [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "de", None, "rare"]), rng.choice(["hot", "hot", "hot", "web", "Book", "", None, "zürich"])
        own = words[:20] + words[20 + sum(map(ord, source or "")) % 40 :: 7]
        rows.append((" ".join(rng.choice(own) for _ in range(rng.randrange(40))) if i % 17 else rng.choice(["", None, "12 34 _", "THE"]), lang, source))
    rows += [("once only here", "single", "alone")] * 2 + [("the of the", "en", "web")] * 40  # repeated rows
    return rows + [(None, "few", "a"), ("", "few", "b"), ("12", "few", "c")]


def found(spark, rows, **more):
    table = spark.createDataFrame([(i, *r, "t", "n", "v") for i, r in enumerate(rows)], SCHEMA)
    got = divergence.audit(table, **more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("rows_of_bucket,held", [(200_000, 2_000_000), (10, 3)])
def test_equals_plain_dictionaries(spark, monkeypatch, rows_of_bucket, held):
    monkeypatch.setattr(divergence, "BUCKET_ROWS", rows_of_bucket)
    monkeypatch.setattr(divergence, "HELD_PAIRS", held)
    rows = corpus()
    want = plain(rows)
    assert {r[2] for r in want} == {"pair", "term"} and len(want) > 200
    assert ("few", "a", "pair", "b", 0, 1) in want and not [r for r in want if r[0] == "single"]
    assert found(spark, rows) == want


def test_other_limits_and_ties(spark):
    rows = [(f"t{chr(97 + i)} base base", "en", s) for i in range(15) for s in ("a", "b") for _ in range(3)] + [("base", "en", "c")]
    for k, least in ((1, 1), (3, 6), (10, 1), (5, 1000)):
        assert found(spark, rows, k=k, least_docs=least) == plain(rows, k, least)


def test_nothing(spark):
    assert found(spark, []) == []


def test_very_long_text(spark):
    rows = [("Lorem ipsum dolor, " * 400_000, "en", "a"), ("lorem", "en", "b")]
    assert found(spark, rows, least_docs=2) == plain(rows, least=2)


def test_terms_and_shares():
    texts = ["A-Z0z[\\]^_`{|}~\x7f\x80é", "", "no\x00nul"]
    coded, at = divergence.terms_of([t.encode() for t in texts])
    assert [(int(i), t.decode()) for i, t in zip(at, coded.dictionary.take(coded.indices).to_pylist())] == [(i, m.translate(LOWER)) for i, t in enumerate(texts) for m in TERM.findall(t)]
    assert isinstance(coded, pa.DictionaryArray)
    for n, total, terms in ((0, 0, 1), (5, 10, 3), (7 * 10**14, 8 * 10**15, 10**9), (10**12, 10**12, 1)):  # counts of a very large corpus
        want = 1 + 10**9 * (n + 2) // (total + 2 * terms)
        assert divergence.share(np.array([n]), np.array([total]), np.array([terms])).tolist() == [want]


def test_share_as_columns(spark):
    rows = [(0, 0, 1), (5, 10, 3), (7 * 10**14, 8 * 10**15, 10**9), (10**12, 10**12, 1)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(rows, "n long, total long, terms long").select(divergence.share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).collect()
    assert [int(r.p) for r in got] == [1 + 10**9 * (n + 2) // (total + 2 * terms) for n, total, terms in rows]


def test_search_stops_early_and_is_exact():
    rng = np.random.default_rng(0)
    n = np.r_[rng.integers(1, 4, 3000), rng.integers(500, 900, 30)]
    total, lang = int(n.sum()), n + rng.integers(0, 2000, len(n))
    v = np.full(len(n), len(n))
    p, q = divergence.share(n, np.full(len(n), total), v), divergence.share(lang, np.full(len(n), int(lang.sum())), v)
    names = [f"t{i:05}" for i in range(len(n))]
    best, opened = divergence.search_terms(p, q, n, names, 10)
    want = sorted((-int(divergence.divergence(a, b)), t) for a, b, t in zip(p, q, names) if a > b)[:10]
    assert best == [(-value, t) for value, t in want]
    assert opened < len(n) / 2
