"""Pairs of patterns and taint paths against a plain walk over all pairs."""

import random
from collections import Counter, defaultdict

import pytest

from auditweave.operators.findings import corroborated

SCHEMA = "file string, cwe string, line long, source string, confidence string, taint_path string, seq long"


def walk(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0], r[1]].append(list(r))
    out = []
    for g in groups.values():
        g.sort(key=lambda r: r[6])
        edges = sorted((abs(p[2] - t[2]), i, j) for i, p in enumerate(g) for j, t in enumerate(g) if p[3] != "taint" and t[3] == "taint" and None not in (p[2], t[2]) and abs(p[2] - t[2]) <= 3)
        used = set()
        for _, i, j in edges:
            if i not in used and j not in used:
                used |= {i, j}
                g[i][5], g[i][4] = g[j][5], "high" if g[j][4] == "high" else g[i][4]
        out += [tuple(r) for k, r in enumerate(g) if not (r[3] == "taint" and k in used)]
    return Counter(out)


@pytest.mark.parametrize("lines", [3, 12, 60, 400])
def test_random_rows(spark, lines):
    rng = random.Random(lines)
    seqs = rng.sample(range(10_000), 400)
    rows = []
    for s in seqs:
        taint = rng.random() < 0.5
        line = None if rng.random() < 0.02 else rng.randrange(lines)
        rows.append((rng.choice(["f", "f", "g", None]), rng.choice(["C1", "C1", "C2"]), line, "taint" if taint else "builtin", rng.choice(["high", "low"]), f"p{s}" if taint else "", s))
    assert Counter(map(tuple, corroborated(spark.createDataFrame(rows, SCHEMA), ["seq"]).collect())) == walk(rows)


def test_one_file_with_very_many_rows(spark):
    from pyspark.sql import functions as F

    i = F.col("id")
    df = spark.range(400_000).select(F.lit("f").alias("file"), F.lit("C").alias("cwe"), F.floor(i / 4).alias("line"), F.when(i % 2 == 0, "taint").otherwise("builtin").alias("source"), F.lit("high").alias("confidence"), i.cast("string").alias("taint_path"), i.alias("seq"))
    got = corroborated(df, ["seq"])
    assert got.agg(F.count("*"), F.count_if(F.col("source") == "builtin"), F.count_if(F.expr("taint_path = cast(seq - 1 as string)"))).first()[:] == (200_000, 200_000, 200_000)
