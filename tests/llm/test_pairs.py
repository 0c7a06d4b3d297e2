"""Vector and fingerprint operators against brute force."""

import random

import numpy as np
import pytest
import xxhash

from tessera.llm import ann, common, pq_dedup, simhash

EMBEDDED = "vec_id long, embedding array<float>, label string, v string"


def embedded(spark, n=300, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:160] = x[7] + rng.normal(size=(60, dim)).astype(np.float32) * 0.05  # near copies
    x[200:260] = x[9]  # exact copies
    rows = [(i, v.tolist(), "l", "v") for i, v in enumerate(x)]
    rows += [(1000, None, None, None), (1001, [0.0] * dim, "", ""), (1002, [float("nan")] + [1.0] * (dim - 1), "", ""), (1003, [None] * dim, "", ""), (1004, [1.0], "", ""), (1005, [], "", "")]
    return spark.createDataFrame(rows, EMBEDDED), {i: v.astype(np.float64) / np.linalg.norm(v.astype(np.float64)) for i, v in enumerate(x)}


def test_pq_links_equal_brute_force(spark, monkeypatch):
    table, x = embedded(spark)
    v = np.stack([x[i] for i in range(300)])
    m = v @ v.T >= 0.95
    roots = common.local_roots(300, *np.nonzero(m))
    for block in (4096, 16):  # one block, and a hot list split into many
        monkeypatch.setattr(pq_dedup, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pq_dedup.pq_neardup(table, 0.95).collect()}
        assert len(got) == 306
        for i in range(300):
            assert got[i] == (int(m[i].sum()) - 1, int(roots[i]), int(roots[i]) == i)
        assert all(got[i] == (0, i, True) for i in range(1000, 1006))
        assert max(links for links, *_ in got.values()) >= 60


def test_pq_of_nothing(spark):
    assert pq_dedup.pq_neardup(spark.createDataFrame([], EMBEDDED)).collect() == []


def test_nearest_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_LIST", 60)
    monkeypatch.setattr(ann, "BLOCK", 32)
    table, x = embedded(spark)
    got = {}
    for r in ann.nearest_neighbours(table, 5, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 300, 10))
    hits = 0
    for q, rows in got.items():
        assert [r for r, *_ in sorted(rows)] == [1, 2, 3, 4, 5] and all(i != q for _, i, _ in rows)
        best = sorted((-float(x[q] @ x[i]), i) for i in range(300) if i != q)[:5]
        hits += len({i for _, i, _ in rows} & {i for _, i in best})
        assert all(abs(s - float(x[q] @ x[i])) < 1e-9 for _, i, s in rows)
    assert hits >= 0.9 * 5 * len(got)


def test_nearest_neighbours_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], "", ""), (1, [1.0, 0.0], "", ""), (2, [0.0, 1.0], "", "")], EMBEDDED)
    assert [(r["rank"], r.vec_id) for r in sorted(ann.nearest_neighbours(few).collect(), key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert ann.nearest_neighbours(spark.createDataFrame([], EMBEDDED)).collect() == []


def plain_fingerprint(text, n):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def texts(seed=1, n=150):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    out = [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(n)]
    for i in range(40):  # near copies
        w = out[i].split() * 6
        w[rng.integers(len(w))] = "changed"
        out += [" ".join(out[i].split() * 6), " ".join(w)]
    return [*out, None, "", " \t", "A", "a", "a b", "É x y z"]


@pytest.mark.parametrize("rows", [20_000, 8])
def test_simhash_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "GROUP_ROWS", rows)  # few: the groups of many signatures are cut into parts
    held = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(held)], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_neardup(docs).collect()}
    prints = np.array([plain_fingerprint(t or "", 3) for t in held], np.uint64)
    roots = common.local_roots(len(held), *np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]) <= 3))
    assert got == {i: (f"{int(p):016x}", int(roots[i])) for i, p in enumerate(prints)}
    assert len(set(roots.tolist())) < len(held) - 30


def test_wide_fingerprints_find_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(0, base), (1, base.replace("w77 ", "other ")), (2, " ".join(f"v{i}" for i in range(200)))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.simhash_neardup(docs, 5, 256, simhash.radius_of(0.8, 256), 20).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    assert simhash.simhash_neardup(docs.limit(0)).collect() == []


def shingle_jaccard(a, b, n=5):
    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else {()}

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("rows", [20_000, 4])
def test_jaccard_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "GROUP_ROWS", rows)
    monkeypatch.setattr(simhash, "PARTNERS", rows)
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 5000)}"
    common_line = [word() for _ in range(15)]
    held = []
    for n in [12, 25, 40, 60, 60, 90, 150, 300] * 4:
        base = [word() for _ in range(n)] + (common_line if rng.random() < 0.5 else [])
        for _ in range(6):  # pairs from 0.6 to 1
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = word()
            held.append(" ".join(w))
    held += [None, "", "one", "One", "a b c d e", "a b c d", held[0] + " ", "x y z x y z " * 40, "x y z x y z " * 4]
    n = len(held)
    j = np.array([[shingle_jaccard(a, b) for b in held] for a in held])
    assert ((j >= 0.8) & (j < 0.9)).sum() > 40 and ((j >= 0.7) & (j < 0.8)).sum() > 40
    roots = common.local_roots(n, *np.nonzero(j >= 0.8))
    docs = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.jaccard_neardup(docs, 5, 0.8, 256, 20).collect()}
    assert got == {i: int(r) for i, r in enumerate(roots)}
    assert simhash.jaccard_neardup(docs.limit(0), 5, 0.8, 256, 20).collect() == []


def test_pigeonhole_plan_covers_the_radius():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 1 << 63, (500, 1), dtype=np.uint64)
    for radius in (0, 3, 7):
        groups, thresholds = simhash.plan(sample, 10**6, 64, radius)
        assert sorted(np.concatenate(groups).tolist()) == list(range(64))
        assert sum(t + 1 for t in thresholds) >= radius + 1


def test_set_fingerprints():
    sets = [[], [5], [1, 2, 3], [7, 2**63, 9, 4]]
    got = simhash.set_fingerprints(np.array([x for s in sets for x in s], np.uint64), np.array([len(s) for s in sets]), 2)
    for s, words in zip(sets, got):
        for k, word in enumerate(words.tolist()):
            h = simhash.textkit.mix(np.array(s, np.uint64) + np.uint64(k * simhash.WORD_STEP & (1 << 64) - 1)).tolist()
            assert word == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_plan_counts_what_meets():
    """Bits that are copies of others or nearly constant: thresholds follow the candidates that the sample shows."""
    rng = np.random.default_rng(4)
    bits = rng.random((3000, 64)) < 0.5
    bits[:, 32:48] &= rng.random((3000, 1)) < 0.05  # hardly ever set, and together: their group selects nothing
    sample = np.packbits(bits, axis=1).view(">u8").astype(np.uint64).reshape(-1, 1)
    value = simhash.group_values(sample, np.arange(32, 40))
    plain = [np.mean(np.bitwise_count(value[:, None] ^ value[None])[np.triu_indices(3000, 1)] <= t) for t in range(3)]
    assert np.allclose(simhash.meetings(value, 8, 2), plain)
    wide = simhash.group_values(sample, np.arange(20))
    assert np.allclose(simhash.meetings(wide, 20, 1)[1], np.mean(np.bitwise_count(wide[:, None] ^ wide[None])[np.triu_indices(3000, 1)] <= 1))
    groups, thresholds = simhash.plan(sample, 10**6, 64, 3)
    assert sum(t + 1 for t in thresholds) == 4 and len(set(thresholds)) > 1
    constant = [t for g, t in zip(groups, thresholds) if np.isin(g, np.arange(32, 48)).mean() > 0.7]
    assert constant and max(constant) < max(thresholds)


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LINKS", 3)
    edges = [(7, i) for i in range(20, 60)] + [(90, i) for i in range(30, 70)] + [(200, 201)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 7 for i in [7, 90, *range(20, 70)]} | {200: 200, 201: 200}


def test_hot_signature_groups_are_whole():
    rng = np.random.default_rng(2)
    words = (np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 20, 900).astype(np.uint64))).reshape(-1, 1)
    a, b = simhash.links_in(np.zeros(900, np.uint64), np.arange(900), words, 2)
    roots = common.local_roots(900, a, b)
    assert set(roots.tolist()) == {0}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (200, 100)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}


def clustered(n, dim, rank, seed):
    """Vectors about 60 centres in a subspace, every third with a near copy displaced within that subspace."""
    rng = np.random.default_rng(seed)
    plane = np.linalg.qr(rng.normal(size=(dim, rank)))[0]
    low = rng.normal(size=(60, rank))[rng.integers(60, size=n)] + 0.5 * rng.normal(size=(n, rank))
    size = np.linalg.norm(low, axis=1)[:, None]
    copies = low[::3] + rng.normal(size=(len(low[::3]), rank)) * size[::3] * 0.3 / np.sqrt(rank)
    return (np.concatenate([low, copies]) @ plane.T).astype(np.float32)


@pytest.mark.parametrize(("dim", "rank", "least"), [(64, 64, 0.999), (64, 12, 0.999), (384, 4, 0.999)])
def test_pq_recall_over_many_lists(spark, monkeypatch, dim, rank, least):
    monkeypatch.setattr(pq_dedup, "PER_LIST", 40)
    x = clustered(1200, dim, rank, seed=3)
    v = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    assert len(pq_dedup.Quantiser(v, len(v), 0.95).centres) >= 16
    cosines = v @ v.T
    true = (cosines >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in pq_dedup.pq_neardup(spark.createDataFrame([(i, r.tolist(), "", "") for i, r in enumerate(x)], EMBEDDED)).collect()}
    found = np.array([got[i] for i in range(len(x))])
    edge = (np.abs(cosines - 0.95) < 1e-9).sum()
    assert true.sum() > 300 and not edge and (found <= true).all()
    assert found.sum() >= least * true.sum()


def test_nearest_neighbours_over_many_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_LIST", 60)
    x = clustered(1500, 64, 16, seed=4)
    v = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    hits = n = 0
    found = {}
    for r in ann.nearest_neighbours(spark.createDataFrame([(i, r.tolist(), "", "") for i, r in enumerate(x)], EMBEDDED), 5, 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, len(x), 20):
        best = np.argsort(np.where(np.arange(len(x)) == q, -2, -0 + v @ v[q]))[::-1][:5]
        hits, n = hits + len(found[q] & set(best.tolist())), n + 5
    assert hits >= 0.9 * n


def test_exact_setting_of_the_distance(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    plain = sorted(map(tuple, simhash.jaccard_neardup(docs, 3, 0.8, 256, 20).collect()))
    assert plain == sorted(map(tuple, simhash.jaccard_neardup(docs, 3, 0.8, 256, 20, deviations=float("inf")).collect()))


def test_pairs_of_a_hot_shingle_come_in_runs(monkeypatch):
    """Every set shares one shingle: all pairs can reach the similarity, and only so many are held at once."""
    monkeypatch.setattr(simhash, "PAIRS", 50_000)
    n = 1500
    c = {"key": np.zeros(n, np.uint32), "ident": np.arange(n), "comp": np.arange(n), "n": np.full(n, 9, np.uint32), "place": np.zeros(n, np.uint32)}
    runs = [len(a) for a, _ in simhash.meet(c, 0.8)]
    assert sum(runs) == n * (n - 1) // 2 and max(runs) < 600_000 and len(runs) > 1


def test_fifty_thousand_unlike_sets_with_one_shingle_stay_small():
    import tracemalloc

    n = 50_000
    c = {"key": np.zeros(n, np.uint32), "ident": np.arange(n), "comp": np.arange(n), "n": (20 * 1.3 ** (np.arange(n) % 25)).astype(np.uint32), "place": np.zeros(n, np.uint32)}
    c["place"] = (c["n"] // 3).astype(np.uint32)  # what is left after the shared shingle is too little for 0.8
    tracemalloc.start()
    assert sum(len(a) for a, _ in simhash.meet(c, 0.8)) == 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500_000_000
