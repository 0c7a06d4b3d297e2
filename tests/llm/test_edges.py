"""Very long texts, repeated rows and ties through the operators that have no such test elsewhere."""

import random

import pytest

from tessera.llm import ann, bpe, licences, packing, pq_dedup, quality, simhash, suffix_dedup, toxicity

public = pytest.importorskip("public_tokenizers")
LABELS = "doc_id long, quality int, toxic int"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(300_000))  # 2 MB
    return [(1, long), (2, "a few words here"), (3, long), (4, long + " and a tail of its own")]


def library(name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_very_long_texts_lose_their_copies(spark, long_rows):
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs_of(spark, long_rows)).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    n = len(long_rows[0][1])
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed, got[4].n_removed) == (0, 0, n, n) and got[3].n_spans == got[4].n_spans == 1
    prints = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_neardup(docs_of(spark, long_rows), ngram=3, bits=64, radius=3).collect()}
    assert prints[1] == prints[3] and prints[4][1] == 1 and prints[2][1] == 2


def test_very_long_texts_are_encoded_whole(spark, long_rows):
    docs = docs_of(spark, long_rows[:2])
    words, bytes_ = library("word_bpe_49k.json"), library("byte_bpe_50k.json")
    got = {r.doc_id: r.n_tokens for r in bpe.digests(bpe.bpe_encode(docs, public.path("byte_bpe_50k.json"))).collect()}
    assert got == {i: len(bytes_.encode(t, add_special_tokens=False).ids) for i, t in long_rows[:2]}
    pieces = packing.pack_documents(docs, public.path("word_bpe_49k.json"), tokens=False).collect()
    for i, t in long_rows[:2]:
        own = sorted((p.start, p.length, p.doc_tokens) for p in pieces if p.doc_id == i)
        n = len(words.encode(t, add_special_tokens=False).ids) + 1
        assert sum(k for _, k, _ in own) == n and all(a + k == b for (a, k, _), (b, _, _) in zip(own, own[1:])) and {d for *_, d in own} == {n}


def test_repeated_rows_are_scored_alike(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["good", "text", "mit", "license", "idiot", "the"]) for _ in range(12))) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(40)] + [(7, 0, True), (7, 1, False)], LABELS.replace("toxic int", "toxic boolean")).selectExpr("doc_id", "quality", "CAST(toxic AS INT) AS toxic")
    docs = docs_of(spark, rows + rows[:5] + [(None, "no id"), (50, None), (50, None)])
    for out in (quality.quality(docs, labels), toxicity.toxicity(docs, labels), licences.licence_scan(docs), bpe.digests(bpe.bpe_encode(docs, public.path("byte_bpe_50k.json"))), simhash.simhash_neardup(docs, ngram=3, bits=64, radius=3)):
        held = [tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in out.collect()]  # sums of one text may differ in the last bit
        at = out.columns.index("doc_id")
        of = lambda i: [r for r in held if r[at] == i]
        assert len({r for i in range(5) for r in of(i)}) == 5 and len(set(of(50))) == 1 and all(r[at] is not None for r in held), out.columns
        assert {r[at] for r in held} == {*range(40), 50}
    packed = packing.pack_documents(docs, public.path("word_bpe_49k.json"), tokens=False).collect()
    assert sorted(p.doc_id for p in packed) == sorted([*range(40), *range(5), 50, 50])
    assert len({(p.sequence_id, p.offset) for p in packed}) == len(packed)


def test_repeated_vectors_and_ties(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    rows[7] = (7, rows[3][1])
    rows[9] = (9, rows[3][1])  # ties
    table = spark.createDataFrame(rows + [rows[5], rows[5], (None, rows[5][1])], "vec_id long, embedding array<double>")
    links = {(r.vec_id, r.component_id) for r in pq_dedup.pq_neardup(table, 0.95).collect()}
    assert {(3, 3), (7, 3), (9, 3), (5, 5)} <= links and {v for v, _ in links} == set(range(60))
    near = [r for r in ann.nearest_neighbours(table, 5, 10).collect()]
    assert {r.query_id for r in near} == set(range(0, 60, 10)) and all(r.vec_id != r.query_id and r.vec_id is not None for r in near)
    for q in {r.query_id for r in near}:
        own = sorted((r["rank"], -r.score, r.vec_id) for r in near if r.query_id == q)
        assert [k for k, *_ in own] == [1, 2, 3, 4, 5] and [x[1:] for x in own] == sorted(x[1:] for x in own)
