"""Places of matches: against Python's own, and their cost in texts with very many matches."""

import re
import time

import pytest
from pyspark.sql import functions as F

from auditweave.functions.text import matches, running


@pytest.mark.parametrize("pattern", ["ab?", r"[0-9]+\n?", r"\n\n", "é."])
def test_places(spark, pattern):
    texts = ["", "ab\nab a\n\n\nb12\n3", "é1é2\n😀é😀ab" * 30, "none", "\n\n\n\n", "a", "12\n" * 100]
    got = {r.t: [tuple(m) for m in r.m] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", matches(F.col("t"), pattern).alias("m")).collect()}
    assert got == {t: [(m.start(), t.count("\n", 0, m.start()) + 1, m.group()) for m in re.finditer(pattern, t)] for t in texts}


def test_pattern_of_a_column(spark):
    rows = [("aXbX", "X"), ("a1b22", "[0-9]+"), ("a1b22", "b")]
    got = spark.createDataFrame(rows, "t string, p string").select(matches(F.col("t"), F.col("p")).alias("m")).collect()
    assert [[(m.start, m.text) for m in r.m] for r in got] == [[(1, "X"), (3, "X")], [(1, "1"), (3, "22")], [(2, "b")]]


def test_running(spark):
    rows = [([],), ([5],), (list(range(1000)),)]
    got = spark.createDataFrame(rows, "x array<long>").select(running(F.col("x")).alias("s"), running(F.col("x"), F.greatest).alias("m")).collect()
    assert [r.s for r in got] == [[sum(x[: i + 1]) for i in range(len(x))] for (x,) in rows]
    assert [r.m for r in got] == [x for (x,) in rows]


def test_two_hundred_thousand_matches_in_one_text(spark):
    df = spark.range(1).select(F.repeat(F.lit("token = x\n"), 200_000).alias("t"))
    began = time.time()
    row = df.select(matches(F.col("t"), "token = ").alias("m")).select(F.size("m").alias("n"), F.element_at("m", -1).alias("last")).first()
    assert (row.n, row["last"].start, row["last"].line) == (200_000, 1_999_990, 200_000)
    assert time.time() - began < 30
