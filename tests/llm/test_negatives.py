"""Hard negatives against a plain search over all pairs."""

import math
import random

import numpy as np
import pytest

from auditweave.llm import negatives
from auditweave.llm.negatives import band, mined

SCHEMA = "vec_id long, embedding array<float>, label int, q string"


def plain(rows):
    clean = set()
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * x) for x in map(float, v))
        if sum(x * x for x in q) < 1 << 62:
            clean.add((i, (label + 1) % 10 if i % 7 == 0 else label, q))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    for a in clean:
        if a[0] % 50:
            continue
        scored = sorted((-dot(a[2], r[2]), r[0], r[1]) for r in clean if r != a)
        for ps, pid, _ in [s for s in scored if s[2] == a[1]][:5]:
            hard = [s for s in scored if s[2] != a[1] and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(a[0], pid, k + 1, n[1], -ps, -n[0]) for k, n in enumerate(hard)]
    return sorted(out)


def vectors(n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) / math.sqrt(dim)
    v[: n // 3] += v[0]  # a cluster, so that scores are close
    v[n // 2 : n // 2 + copies] = v[1]
    return [(i, np.float32(x).tolist(), int(rng.integers(0, 4)), "x") for i, x in enumerate(v)]


@pytest.mark.parametrize(("n", "dim", "seed", "copies"), [(700, 16, 1, 0), (600, 3, 2, 250), (400, 1, 3, 0), (450, 64, 4, 100)])
def test_all_pairs(spark, monkeypatch, n, dim, seed, copies):
    monkeypatch.setattr(negatives, "ROWS", 150)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rows = vectors(n, dim, seed, copies)
    want = plain(rows)
    assert sorted(map(tuple, mined(spark.createDataFrame(rows, SCHEMA)).collect())) == want
    assert len(want) > 20


def test_edges(spark):
    rows = vectors(120, 4, 5) + [(None, [1.0] * 4, 1, "a"), (150, None, 1, "a"), (151, [1.0, None, 0.0, 0.0], 1, "a"), (152, [float("nan")] * 4, 1, "a"), (153, [float("inf")] * 4, 1, "a"), (154, [3e38] * 4, 1, "a"), (155, [1.0] * 4, None, "a")]
    rows += [(200, [], 2, "e"), (201, [0.5], 2, "short"), (250, [0.0] * 4, 3, "zero"), (300, [1e5, 1e5, -1e5, 0.0], 0, "large"), (301, [1e5, 9e4, -1e5, 1.0], 0, "large"), (302, [9e4, 9e4, -9e4, 1.0], 1, "large")]
    rows += rows[:60] + [(50, [0.25, 0.5, 0.75, 1.0], 1, "same id"), (50, [0.5, 0.5, 0.75, 1.0], 1, "same id")]
    rng = random.Random(1)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, mined(df).collect())) == plain(rows)
    assert mined(df.limit(0)).collect() == []
    assert mined(df.filter("vec_id % 50 <> 0")).collect() == []
    assert mined(df.filter("vec_id = 50")).collect() == []


def test_bands_are_exact_beyond_doubles():
    for p in [0, 1, 19, 20, 21, -7, (1 << 61) + 3]:
        lo, hi = band(p, 50, 95)
        inside = lambda n, p=p: 50 * p <= 100 * n <= 95 * p
        if lo <= hi:
            assert inside(lo) and inside(hi) and not inside(lo - 1) and not inside(hi + 1)
        else:
            assert not any(map(inside, range(hi - 2, lo + 3)))
