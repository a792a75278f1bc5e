"""Operator 11 against all inner products."""

import random

import numpy as np
import pytest

from graphloom.llm import hard_negatives as H

NAN, INF = float("nan"), float("inf")


def expected(rows, every):
    """rows: (vec_id, embedding, label)"""
    own = []
    for v, e, label in rows:
        if v is None or e is None or label is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        q = [int(max(-H.MOST, min(H.MOST, np.floor(256 * float(np.float32(x)))))) for x in e]
        own.append((v, (label + 1) % 10 if v % 7 == 0 else label, q))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for v, label, q in own:
        if v % every:
            continue
        scored = sorted((-dot(q, r), w, other) for w, other, r in own)
        for s, w in [(-s, w) for s, w, other in scored if other == label and w != v][:5]:
            inside = [(-t, u) for t, u, other in scored if other != label and 30 * s <= -100 * t <= 90 * s]
            out += [(v, w, k + 1, u, s, t) for k, (t, u) in enumerate(inside[:10])]
    return sorted(out)


def found(spark, rows, every=100, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, q string, anchor int").repartition(parts)
    return sorted(tuple(r) for r in H.mine(df, every).collect())


@pytest.mark.parametrize("seed", range(3))
def test_negatives_brute(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    dims = [6, 7, 1][seed]
    centres = rng.normal(size=(4, dims))
    rows = [(int(k), (centres[k % 4] + rng.normal(size=dims) * 0.6).round(seed + 1).tolist(), int(rng.integers(0, 4) if k % 3 else k % 4)) for k in range(-40, 360)]
    rows += [(1000 + k, centres[0].tolist(), 2) for k in range(60)] + [(2000 + k, centres[0].tolist(), 3) for k in range(60)]
    rows += [(None, [1.0] * dims, 1), (3000, None, 1), (3010, [None] * dims, 1), (3020, [NAN] * dims, 1), (3030, [INF] * dims, 1), (3040, [1.0] * dims, None), (3050, [], 1), (3060, [0.0] * dims, 1), (3070, [0.5], 2)]
    want = expected(rows, 10)
    assert want and found(spark, rows, 10) == want
    # many slices of anchors, small blocks
    monkeypatch.setattr(H, "ANCHORS", 9)
    assert found(spark, rows, 10, 2) == want


def test_bounds_hold_and_spare_most_rows():
    rng = np.random.default_rng(4)
    q = np.floor(256 * rng.normal(size=(3000, 16)) / 4).astype(np.int32)
    ends = np.quantile(q, np.arange(1, H.CELLS) / H.CELLS, axis=0, method="inverted_cdf").T.copy()
    cells = H.cell_of(q, ends)
    low, high = (np.array([[f(q[cells[:, d] == c, d], initial=0) if (cells[:, d] == c).any() else 0 for c in range(H.CELLS)] for d in range(16)]) for f in (lambda x, initial: x.min(), lambda x, initial: x.max()))
    packed = np.ascontiguousarray((cells[:, 0::2] * H.CELLS + cells[:, 1::2]).T)
    bounds, spared = H.Bounds(low, high), 0
    for a in q[:20]:
        least, most = bounds.sums(packed, bounds.tables(a))
        exact = q.astype(np.int64) @ a
        assert (least <= exact).all() and (exact <= most).all()
        best = H.Best(5)
        spared += len(q) - H.first_positives(best, np.arange(len(q)), q, packed, a, bounds)
        assert best.score.tolist() == sorted(exact.tolist())[:-6:-1]
    assert spared > 0.9 * 20 * len(q)


def test_windows():
    for score in (-7, 0, 1, 3, 10, 99, 12345):
        lo, hi = H.window(score)
        assert [s for s in range(-20, 12400) if 30 * score <= 100 * s <= 90 * score] == list(range(lo, hi + 1))


def test_large_components_and_repeats(spark):
    rows = [(0, [1e30, -1e30], 1), (1, [1e30, 1.0], 1), (2, [4e5, 1.0], 2), (100, [1.0, 2.0], 1), (100, [1.0, 2.0], 1)]
    got = found(spark, rows)
    assert [r for r in got if r[0] == 0] == [r for r in expected(rows, 100) if r[0] == 0]
    hundred = [r for r in got if r[0] == 100]
    assert hundred == sorted(hundred) and len(hundred) % 2 == 0


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []


def test_against_sql(compare):
    compare(H.op11_hard_negatives, H.OP11_SQL)
    compare(H.op11_hard_negatives, H.OP11_SQL, "/root/testdata/sf0.01")
