"""Text operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, features, licences, packing, quality, repeats, substring_dedup, suffix_dedup, textkit, toxicity

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, n_bytes string, kept string, word string, severity string, score string"


def docs_of(spark, held):
    return spark.createDataFrame([(i, t, "x", "y", "z", "s", "t") for i, t in enumerate(held)], SCHEMA)


def corpus(seed=0):
    rng = random.Random(seed)
    words = "alpha beta gamma delta ünder é the of and to".split()
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(n))
    passages = [text(rng.randint(8, 60)) for _ in range(6)]
    held = [" ".join([text(rng.randint(0, 40)), rng.choice(passages), text(rng.randint(0, 40))]) for _ in range(60)]
    held += [held[3], held[3], "a " * 300, "a " * 300, "ab" * 200, passages[0] * 3, None, "", " ", "x", "y" * 49, "y" * 50, "y" * 50, "the same\n" * 60]
    return held


def test_suffix_dedup_equals_brute_force(spark):
    held = corpus()
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs_of(spark, held)).collect()}
    first = {}
    for d, t in enumerate(held):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for d, t in enumerate(held):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()), d


def test_substring_dedup_equals_brute_force(spark):
    held = corpus(1)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs_of(spark, held)).collect()}
    seen = set()
    for d, t in enumerate(held):
        w = (t or "").split()
        gone = [0] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [1] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        r = got[d]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), d
        assert r.kept == (kept if sum(gone) else (t or ""))


def test_repeats_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.suffix_dedup(none).collect() == [] and substring_dedup.substring_dedup(none).collect() == []


def test_repeated_rows_are_one_document(spark):
    held = corpus(2)[:30]
    docs = docs_of(spark, held)
    for operator in (suffix_dedup.suffix_dedup, substring_dedup.substring_dedup):
        once = sorted(map(tuple, operator(docs).collect()), key=str)
        twice = sorted(map(tuple, operator(docs.unionByName(docs)).collect()), key=str)
        assert twice == sorted(once * 2, key=str)
    other = docs.unionByName(spark.createDataFrame([(i, "short", *"abcde") for i in range(30)], SCHEMA))
    assert suffix_dedup.suffix_dedup(other).count() == 60 == substring_dedup.substring_dedup(other).count()


def test_different_texts_of_one_id_lose_no_more_than_they_have(spark):
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(300))
    rows = [(1, long), (2, "0123456789"), (2, "zz" + long), (2, None)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_removed <= r.n_bytes and all(0 <= a < b <= r.n_bytes for a, b in zip(r.starts, r.ends)) for r in got)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(1, 300, 0, 0), (2, 0, 0, 0), (2, 10, 8, 1), (2, 302, 300, 1)]


def test_different_contexts_are_not_folded():
    """300,000 texts of one window that differ in the last bytes only: 32 bits of a hash would take some for equal."""
    rng, n, window, gram = np.random.default_rng(3), 300_000, suffix_dedup.WINDOW, suffix_dedup.GRAM
    for _ in range(100):
        head = np.tile(rng.integers(97, 123, window - 4), (n, 1))
        tail = np.stack([97 + np.arange(n) // 24**k % 24 for k in range(4)], axis=1)
        values = np.c_[head, tail].astype(np.uint64).ravel()
        lo = np.arange(n) * window
        c, _ = textkit.seeds(values[:window], True, lo[:1], lo[:1] + window, window, gram)
        if (window - gram) // 2 + 1 < c["left"][0] <= window - 4 - gram:  # the seed stands late, so no `after` tells them apart
            break
    c, _ = textkit.seeds(values, True, lo, lo + window, window, gram)
    c["doc"] = c.pop("piece").astype(np.int64)
    left, copies = repeats.fold(c, False)
    assert len(left["doc"]) == n and not len(copies["doc"])


def plain_substrings(held, window=20):
    """(n_words, n_removed, kept) of each text in order of doc_id, by comparing words."""
    seen, out = set(), []
    for t in held:
        w = (t or "").split()
        gone = [0] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [1] * window
            seen.add(key)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def plain_suffixes(held, window=50):
    """(n_removed, spans) of each text in order of doc_id, by comparing bytes."""
    first, out = {}, []
    for d, t in enumerate(held):
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], d)
    for d, t in enumerate(held):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < d:
                gone[i : i + window] = b"\1" * window
        out.append((sum(gone), [m.span() for m in re.finditer(b"\1+", bytes(gone))]))
    return out


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_words_that_plain_hashes_confuse(spark):
    """Words and sequences that every polynomial hash modulo 2**64 takes for equal, and very long words."""
    rest = " ".join(f"r{i}" for i in range(19))
    held = []
    for n in (1024, 4096):
        held += [f"{thue_morse(n)} {rest} x{n}", f"{thue_morse(n, 'b', 'a')} {rest} y{n}"]
    held += [thue_morse(64, "one ", "two "), thue_morse(64, "two ", "one ")]
    long = "z" * 1_000_000
    held += [f"{long} {rest} p", f"{long}! {rest} q", f"u {long} {rest}", None, ""]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs_of(spark, held)).collect()}
    for d, (n, removed, kept) in enumerate(plain_substrings(held)):
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest()), d
    assert got[1].n_removed == 0 and got[8].n_removed >= 20


@pytest.mark.parametrize("window", [50, 300, 400])
def test_windows_of_any_length(spark, window):
    rng = random.Random(window)
    line = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    shared = line(700)
    held = [line(100) + shared, shared, line(50) + shared[:450] + line(50), shared[100:], line(902), shared + line(20)]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs_of(spark, held), window).collect()}
    for d, (removed, spans) in enumerate(plain_suffixes(held, window)):
        assert (got[d].n_removed, list(zip(got[d].starts, got[d].ends))) == (removed, spans), d
    words = [" ".join(t) for t in held]
    few = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs_of(spark, words), window).collect()}
    assert few == {d: removed for d, (_, removed, _) in enumerate(plain_substrings(words, window))}
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(docs_of(spark, held), 10)


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    """Every key that two different contexts share is hot: by halves, and by whole windows."""
    monkeypatch.setattr(repeats, "SHOWN", 2)
    monkeypatch.setattr(repeats, "HOT", 2)
    rng = random.Random(6)
    common_words, common_bytes = " ".join(f"c{i}" for i in range(9)), "the licence of this text is here"
    own = lambda n: " ".join(f"o{rng.randint(0, 9)}" for _ in range(n))
    held = [f"{own(30)} {common_words} {own(30)} {common_bytes} {own(12)}" for _ in range(60)] + corpus(3)
    docs = docs_of(spark, held)
    for s in (repeats.Settings("byte", 50, 12, False, True), repeats.Settings("word", 20, 8, True, False)):
        assert any(map(len, repeats.hot_keys(docs.select("doc_id", "text"), s, len(held), sum(len(t or "") for t in held))))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert [(got[d].n_words, got[d].n_removed) for d in range(len(held))] == [x[:2] for x in plain_substrings(held)]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert [(got[d].n_removed, list(zip(got[d].starts, got[d].ends))) for d in range(len(held))] == plain_suffixes(held)


def test_interval_tree_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        t = bytes(rng.choice(b"ab") for _ in range(50))
        starts = np.arange(44)
        ends = np.minimum(starts + rng.randint(3, 30), 50)
        order, lcp = suffix_dedup.enhanced_suffix_array(np.frombuffer(t, np.uint8), starts, ends)
        cut = [t[a:b] for a, b in zip(starts, ends)]
        assert order.tolist() == sorted(range(44), key=lambda i: (cut[i], i))
        before = np.array([-1 if i % 7 == 0 else t[i - 1] for i in order])
        expected = set()
        for k in range(3, 31):
            i = 0
            while i < 44:
                j = i
                while j + 1 < 44 and lcp[j + 1] >= k:
                    j += 1
                if j > i and lcp[i + 1 : j + 1].min() == k and (len(set(before[i : j + 1].tolist())) > 1 or -1 in before[i : j + 1]):
                    expected.add((k, i, j))
                i = j + 1
        assert set(suffix_dedup.maximal_repeats(lcp, before, 3)) == expected


ODD = ["", " ", "  a\n\n b\t", "<|endoftext|>x<|endoftext|> y", "a\x1c\x1d!b", "don't we'll", "é̀ 漢字漢 🙂🙂", "x \u0085y", "a" * 3000, "-" * 200, "x\x00y", "ΟΔΟΣ. ΣΑΣ Σ!", "İ. İb", "0123 ½", "'S's.'t"]


def mixed(n=400):
    rng = random.Random(4)
    parts = list("abcdehinorstABΣé漢0123 \n'.,!-_") + ["the", "ing", " th", "<|endoftext|>"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 80))) for _ in range(n)] + ["".join(chr(rng.randint(1, 0x3000)) for _ in range(20)) for _ in range(n)]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_automaton_encodes_as_the_library(spark):
    held = [*mixed(), None]
    t = library("byte_bpe_50k.json")
    rows = {r.doc_id: r for r in bpe.bpe_encode(docs_of(spark, held), public.path("byte_bpe_50k.json")).collect()}
    digests = {r.doc_id: r for r in bpe.digests(bpe.bpe_encode(docs_of(spark, held), public.path("byte_bpe_50k.json"))).collect()}
    for d, text in enumerate(held):
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert rows[d].ids == ids and rows[d].decoded == decoded
        assert digests[d].n_tokens == len(ids) and digests[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and digests[d].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_packing(spark):
    held = [*mixed(100), None, "word " * 9000, "word " * 2047]
    t = library("word_bpe_49k.json")
    rows = packing.pack_documents(docs_of(spark, held), public.path("word_bpe_49k.json")).collect()
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for d, text in enumerate(held):
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(docs[d], key=lambda r: r.start):
            piece = ids[at : at + r.length]
            assert (r.start, r.ids, r.doc_tokens, r.ids_crc32) == (at, piece, len(ids), zlib.crc32(np.array(piece, "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), public.path("word_bpe_49k.json"), tokens=False).collect() == []


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(0)
    sizes = np.arange(1, 129)
    demand = np.floor(rng.integers(50, 5000, 128) / np.where(sizes > 64, 8, 1))  # small enough that whole sequences can be filled
    plan = packing.cutting_stock(sizes, demand, 128)
    assert (sum(p * n for p, n in plan) == demand).all() and all((p * sizes).sum() <= 128 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.005 * (sizes * demand).sum() / 128 + 128
    assert packing.cutting_stock(np.array([3]), np.array([5.0]), 8) and packing.cutting_stock(np.zeros(0, int), np.zeros(0), 8) == []


def test_licences_equal_brute_force(spark):
    held = [None, "", "MIT License mit  LICENSE. cc-by cc_by mit", "license mit ccé by É cc\nby", "GNU General Public License version 3 gnu general", "Licensed under the Apache License, Version 2.0.", "mit mit license", "by cc", "gnu lesser general public license"] + ["filler words"] * 30
    got = {r.doc_id: r for r in licences.licence_scan(docs_of(spark, held)).collect()}
    for d, t in enumerate(held):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        places = [(i, label) for phrase, label in licences.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert {x for _, x in places} <= set(r.labels.split(",")) or not places
        assert 0 <= r.score <= 1
    assert "gpl-3" in got[4].labels and "apache-2.0" in got[5].labels and got[8].labels == "lgpl"
    assert licences.licence_scan(spark.createDataFrame([], SCHEMA)).collect() == []


def labelled(spark, n=1200):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        good, toxic = i % 4 > 0, i % 6 == 0
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if not good:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "Moron", "scumming", "scumfest"]))
        rows.append((i, " ".join(w), "x", "y", "z", "s", "t"))
        labels.append((i, int(good), int(toxic), "text"))
    rows += [(n, None, *"abcde"), (n + 1, "", *"abcde")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1, ""), (n, None, None, "")], "doc_id long, quality int, toxic int, text string")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == 1202 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id < 1200]
    assert sum(r.predicted == (r.doc_id % 4 > 0) for r in own) >= 0.97 * len(own)
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).collect() == []


def test_long_rows_do_not_end_the_training_set(spark):
    rows = [(i, "x" * (900 if i % 3 == 0 else 10), "k", "b", "n", "w", "s", "c", "f", "v") for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + [(1, rows[1][1])] * 3 + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    texts, values = quality.labelled(docs, labels, F.col("quality"), 1000, 600)
    learnt = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    short = [i for i in learnt if i % 3]
    assert sorted(map(len, texts)) == sorted([10] * len(short) + [0] * (2 in learnt)) and len(values) == len(texts)  # every short row, once; no long one fits
    assert len(quality.labelled(docs, labels, F.col("quality"), 1000, 1500)[0]) == len(texts) + 1
    assert len(quality.labelled(docs, labels, F.col("quality"), 5, 10**6)[0]) == 5
    assert quality.labelled(docs.limit(0), labels, F.col("quality"))[0] == []


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    own = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id < 1200]
    assert sum(r.toxic == (r.doc_id % 6 == 0) for r in own) >= 0.97 * len(own)
    assert all(0 <= r.severity <= 2 for r in rows) and not any(r.toxic for r in rows if r.doc_id >= 1200)
    assert not any(r.toxic for r in toxicity.toxicity(docs, labels.limit(0)).collect())


def test_ordinal_grades_are_ordered():
    texts = [b"calm words"] * 60 + [b"rude calm"] * 60 + [b"rude vile foul calm"] * 60
    model = toxicity.fit(texts, np.repeat([0, 1, 1], 60), epochs=8, l1=0.1)
    low, mid, high = model.above([b"calm words", b"rude calm", b"rude vile foul calm"]).sum(axis=1)
    assert low < mid < high and model.thresholds[0] < model.thresholds[1]


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain_hash(token):
    return plain_mix(sum((b + 1) * pow(features.BYTE_BASE, i, 2**64) for i, b in enumerate(token)) % 2**64 ^ len(token) << 48)


def plain_tokens(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+", text)


ODD_TEXTS = [None, "", " \t", "one", "one one one", "A-b c!! Ünder ünder, to to", "idiots idiot Idiotic", "\0 x", "the end. " * 400]


def test_quality_score_by_plain_dictionaries(spark):
    model = quality.Logistic(np.random.default_rng(1).normal(size=1 << features.BITS).astype(np.float32), -0.3, 2)
    got = {r.doc_id: r.score for r in quality.score_quality(docs_of(spark, ODD_TEXTS), model).collect()}
    for d, text in enumerate(ODD_TEXTS):
        h = [plain_hash(t) for t in plain_tokens((text or "").encode())]
        grams = h + [features.REPEAT if a == b else plain_mix((a * features.WORD_BASE + b) % 2**64) for a, b in zip(h, h[1:], strict=False)]
        counts = {}
        for g in grams:
            counts[g >> 64 - features.BITS] = counts.get(g >> 64 - features.BITS, 0) + 1
        value = {s: 1 + math.log(n) for s, n in counts.items()}
        size = math.sqrt(sum(x * x for x in value.values())) or 1
        want = 1 / (1 + math.exp(-(sum(float(model.weights[s]) * x / size for s, x in value.items()) + model.bias)))
        assert abs(got[d] - want) < 1e-5


def test_severity_by_plain_dictionaries(spark):
    model = toxicity.Ordinal(np.random.default_rng(2).normal(size=1 << features.BITS).astype(np.float32), np.array([0.5, 1.5]))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs_of(spark, ODD_TEXTS), model).collect()}
    for d, text in enumerate(ODD_TEXTS):
        tokens = plain_tokens((text or "").encode().lower())
        slots = {plain_hash(t) >> 64 - features.BITS for t in tokens}
        slots |= {plain_mix((plain_hash(t[:n]) + n) % 2**64) >> 64 - features.BITS for t in tokens for n in toxicity.PREFIXES if len(t) > n}
        s = sum(float(model.weights[x]) for x in slots)
        above = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        each = [1 - above[0], above[0] - above[1], above[1]]
        assert abs(got[d].severity - sum(above)) < 1e-5 and got[d].grade == each.index(max(each)) and got[d].toxic == (above[0] >= toxicity.THRESHOLD)


def test_licence_labels_and_scores_equal_brute_force(spark):
    rng = random.Random(5)
    pool = sorted({w for _, _, words, _, _ in licences.templates() for w in words}) + ["filler", "other"]
    held = [None, "", "released under that mit license"]
    for label, _, words, _, _ in licences.templates() * 3:
        w = [rng.choice(pool) for _ in range(rng.randint(0, 12))] + [x if rng.random() < 0.85 else "altered" for x in words] + [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        held.append(" ".join(w))
    got = {r.doc_id: r for r in licences.licence_scan(docs_of(spark, held)).collect()}
    split = [(t or "").split() for t in held]
    idf = {w: math.log((len(held) + 1) / (sum(w in s for s in split) + 1)) for w in pool}
    for d, w in enumerate(split):
        labels, score = set(), 0.0
        for label, _, words, at, length in licences.templates():
            rare = licences.posted_words(words, at, length, idf)
            total = sum(idf[x] + 1e-9 for x in words)
            for start in range(-len(words), len(w)):
                stands = [0 <= start + i < len(w) and w[start + i] == x for i, x in enumerate(words)]
                if sum(stands[i] for i in rare) >= 2:
                    score = max(score, sum(idf[x] + 1e-9 for x, s in zip(words, stands, strict=True) if s) / total)
            phrase = words[at : at + length]
            if any(w[i : i + length] == phrase for i in range(len(w))):  # whatever the corpus
                labels.add(label)
        assert got[d].labels == ",".join(sorted(labels)), (held[d], labels)
        assert abs(got[d].score - min(score, 1)) < 1e-9


def test_licence_labels_do_not_hang_on_the_corpus(spark):
    phrases = [(label, " ".join(words[at : at + length])) for label, _, words, at, length in licences.templates()]
    for others in ([], ["licensed under"] * 3, ["apache license version"] * 40 + ["2 0"] * 40):
        held = [f"{p}" for _, p in phrases] + others
        got = {r.doc_id: r.labels.split(",") for r in licences.licence_scan(docs_of(spark, held)).collect()}
        assert all(label in got[i] for i, (label, _) in enumerate(phrases))
    assert "apache-2.0" in {r.doc_id: r for r in licences.licence_scan(docs_of(spark, ["apache license, version 2 0", "x", "y"])).collect()}[0].labels


def test_empty_tables(spark):
    docs, labels = labelled(spark, 12)
    none = docs.limit(0)
    assert toxicity.toxicity(none, labels).collect() == [] and quality.quality(none, labels.limit(0)).collect() == []
    assert bpe.bpe_encode(none, public.path("byte_bpe_50k.json")).collect() == [] and packing.pack_documents(none, public.path("word_bpe_49k.json")).collect() == []


def test_very_long_texts(spark):
    """A text of 5 MB and one word of 20 MB, with their copies."""
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(640_000))
    word = "ab" * 10_000_000
    docs = docs_of(spark, [long, word, "short text", word + " tail", long])
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(option)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed").collect()}
    assert [got[i].n_words for i in range(5)] == [640_000, 1, 2, 2, 640_000] and [got[i].n_removed for i in range(5)] == [0, 0, 0, 0, 640_000]
    model = quality.Logistic(np.zeros(1 << features.BITS, np.float32), 0.0, 2)
    assert {r.score for r in quality.score_quality(docs, model).collect()} == {0.5}
    scanned = {r.doc_id: r.n_words for r in licences.licence_scan(docs).collect()}
    assert scanned == {0: 640_000, 1: 1, 2: 2, 3: 2, 4: 640_000}
    assert spark.conf.get(option) == before
