"""Chunks of files against a plain walk."""

import random

import pytest

from auditweave.operators.model_merge import packed_chunks


def walk(sizes, budget, most):
    out, chunk, used = [], 0, 0
    for n in sizes:
        n = n or 0
        if used > 0 and used + n > budget:
            chunk, used = chunk + 1, 0
        used += n
        out.append(chunk if chunk < most else None)
    return out


@pytest.mark.parametrize(("budget", "most"), [(10, 5), (10, 1000), (1, 40), (0, 7), (100, 1), (50, 64)])
def test_against_a_walk(spark, budget, most):
    rng = random.Random(budget * 1000 + most)
    rows, want = [], {}
    for scan in ("a", "b", None, "c"):
        sizes = [rng.choice([0, 0, 1, 2, 3, 9, 10, 11, 25, None]) for _ in range({"a": 300, "b": 1, None: 40, "c": 90}[scan])]
        if scan == "c":
            sizes = [0] * 90
        rows += [(scan, f"f{i:04}", n) for i, n in enumerate(sizes)]
        want |= {(scan, f"f{i:04}"): c for i, c in enumerate(walk(sizes, budget, most))}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "scan string, file string, n long")
    assert {(r.scan, r.file): r.chunk for r in packed_chunks(df, budget, most, ["file"], ["scan"]).collect()} == want
    sizes = [n for scan, _, n in rows if scan == "a"]
    alone = spark.createDataFrame([(f"f{i:04}", n) for i, n in enumerate(sizes)], "file string, n long")
    assert {r.file: r.chunk for r in packed_chunks(alone, budget, most, ["file"]).collect()} == {f"f{i:04}": c for i, c in enumerate(walk(sizes, budget, most))}
    assert packed_chunks(df.limit(0), budget, most, ["file"], ["scan"]).collect() == []
