"""Hard negatives against plain scores of all rows."""

import math
import struct

import numpy as np
import pytest

from tessera.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, c string, list string, least string"


def rows_of(n=400, dim=9, seed=0, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = (centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)
    x[40:90] = x[3]  # copies: ties
    return [(i, v.tolist(), int(rng.integers(0, labels))) for i, v in enumerate(x)]


def plain(rows, every=50, low=50, high=95):
    v = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        c = tuple(math.floor(256 * float(np.float32(x))) for x in e)
        v[i] = min(v.get(i, (label, c)), (label, c), key=lambda x: (x[0], struct.pack(f"<{len(x[1])}q", *x[1])))
    out = []
    for a, (label, q) in v.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, c)), i, of) for i, (of, c) in v.items() if i != a and len(c) == len(q))
        for s, p, _ in [x for x in scores if x[2] == label][:5]:
            fits = [(n, -m) for m, n, of in scores if of != label and low * -s <= 100 * -m <= high * -s][:3]
            out += [(a, p, rank + 1, n, -s, m) for rank, (n, m) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **more):
    rows = [(i, e if e is None else [x if x is None else float(x) for x in e], label) for i, e, label in rows]
    table = spark.createDataFrame([(*r, "c", "l", "x") for r in rows], SCHEMA)
    got = negatives.hard_negatives(table, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("lists,block,tile,dim", [(8000, 8192, 8192, 9), (40, 16, 3, 9), (100, 64, 8192, 8)])
def test_equals_plain_scores(spark, monkeypatch, lists, block, tile, dim):
    for name, value in (("PER_LIST", lists), ("BLOCK", block), ("TILE", tile)):
        monkeypatch.setattr(negatives, name, value)
    rows = rows_of(dim=dim)
    want = plain(rows, every=10)
    assert len(want) > 200
    assert mined(spark, rows, every=10) == want


def test_odd_rows(spark):
    nan = float("nan")
    rows = rows_of(60, 4)
    rows += [(100, None, 1), (150, [nan, 0, 0, 0], 1), (200, [None, 0, 0, 0], 1), (250, [1.0, 0, 0, 0], None), (None, [1.0, 0, 0, 0], 1)]
    rows += [(300, [], 0), (301, [], 0), (302, [], 1), (350, [0.0] * 4, 0), (400, [1.0, 2.0], 0), (401, [1.0, 2.0], 0), (402, [1.0, 1.0], 1), (-50, [0.5, 0.5, 0, 0], 2), (450, [3e38] * 4, 1)]
    rows += [(7, [1.0, 1, 1, 1], 0), (7, [1.0, 1, 1, 1], 0), (50, [9.0, 0, 0, 0], 2)]  # repeated ids
    table = [r for r in rows if r[0] != 450]  # too long for scores in a long: takes no part
    got = mined(spark, rows)
    assert got == plain(table)
    assert {300, 400, -50, 0, 50} <= {r[0] for r in got}
    assert [r for r in got if r[0] == 300] == [(300, 301, 1, 302, 0, 0)]  # a window of zero


def test_nothing_and_one_label(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(i, [1.0], 1) for i in range(60)]) == []
    assert mined(spark, [(i, [1.0], i) for i in range(60)]) == []  # no positives


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(2)
    c = rng.integers(-200, 200, (500, 33))
    tile = negatives.Approximation(c)
    for q in rng.integers(-200, 200, (20, 33)):
        low, high = tile.bounds(q, slice(50, 450))
        exact = c[50:450] @ q
        assert (low <= exact).all() and (exact <= high).all()
        assert ((high - low) < 33 * 200 * 30).all() and (high >= np.sort(exact)[-5]).sum() < 400
    big = rng.integers(-(2**28), 2**28, (50, 5))  # products beyond the whole numbers of a double
    tile = negatives.Approximation(big)
    q = rng.integers(-(2**28), 2**28, 5)
    low, high = tile.bounds(q, slice(0, 50))
    exact = [sum(int(a) * int(b) for a, b in zip(q, r)) for r in big]
    assert tile.exact(q, np.arange(50)).tolist() == exact
    assert all(a <= x <= b for a, x, b in zip(low.tolist(), exact, high.tolist()))


def test_windows():
    for p in (-3, 0, 1, 2, 3, 99, 100, 101, 65_536, 2**61):
        inside = lambda n: 50 * p <= 100 * n <= 95 * p
        a, b = negatives.window(p, 50, 95)
        assert (a > b) or (inside(a) and inside(b))
        assert not inside(a - 1) and not inside(b + 1)
