import random

import pytest

from pyspark.sql import functions as F

from auditweave.llm.mixing import mixed, numbered, resampled, settle, sized


def brute_targets(sizes):
    """Share by weight, stop at three times the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        per = left / sum(weight[s] for s in free)
        stop = {s for s in free if per * weight[s] > 3 * sizes[s]}
        if not stop:
            return target | {s: per * weight[s] for s in free}
        target |= {s: 3.0 * sizes[s] for s in stop}
        left -= sum(3.0 * sizes[s] for s in stop)
        free -= stop
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_targets(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(1500):
        source = rnd.choice(["a", "a", "a", "a", "B", "é", "tiny" if rnd.random() < 0.05 else "a", None])
        rows.append((i, " ".join(["w"] * rnd.choice([0, 1, 5, 30, 400])), source, 1))
    rows += [(5000, None, "a", 1), (5001, "x\x0by z", "a", 1), (5001, "x\x0by z", "a", 1), (None, "q r", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)
    got = mixed(df).join(df.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        if r.doc_id is not None:
            sizes[r.source] = r.source_size
            taken[r.source] = taken.get(r.source, 0) + r.taken
            assert r.taken == r.size * r.copies and 0 <= r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for r in got:
        if r.doc_id is not None:
            assert r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.01 * t), s
    again = mixed(df.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in mixed(df).collect())


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    assert [(r.size, r.source_size, r.target, r.taken) for r in mixed(df).collect()] == [(2, 2, 2.0, 2)]
    assert mixed(df.limit(0)).count() == 0
    assert [r.taken for r in mixed(df.withColumn("text", df.text.substr(1, 0))).collect()] == [0]


@pytest.mark.parametrize("ids", ["null", "equal"])
def test_hot_ids_share_no_leaf(spark, ids):
    """20,000 rows of a source without ids, or with one id; half of them with one text."""
    rows = [(None if ids == "null" else 7, "w " * 3 if i % 2 else f"w{i} " * (1 + i % 9), "a") for i in range(20000)] + [(None, "x " * 5000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixed(df).collect()
    assert len(got) == len(rows)
    a = [r for r in got if r.source_size != 5000]
    assert all(r.taken == r.size * r.copies and 0 <= r.copies <= 3 for r in got)
    assert abs(sum(r.taken for r in a) - a[0].target) <= 9
    largest = numbered(sized(df)).groupBy("source", "doc_id", "th", "k").count().agg({"count": "max"}).first()[0]
    assert largest == 1
    assert sorted(map(repr, mixed(df.repartition(3)).collect())) == sorted(map(repr, got))


def test_a_leaf_keeps_mass_and_leaves_one_fraction(spark):
    """settle against its contract: sizes and ids kept, mass of the words kept, all but one integral."""
    rnd = random.Random(5)
    groups = [[(rnd.randrange(10**9), 100 * g + i, rnd.randint(1, 500), i, rnd.uniform(0.01, 0.99), False) for i in range(rnd.randint(1, 30))] for g in range(40)]
    df = spark.createDataFrame([(g, m) for g, m in enumerate(groups)], "g int, m array<struct<h:long,doc_id:long,size:long,rid:long,pi:double,settled:boolean>>")
    for g, out in df.select("g", settle(F.array_sort("m"), 0)).collect():
        mine = {m[1]: m for m in groups[g]}
        assert sorted(o.doc_id for o in out) == sorted(mine) and all(o.size == mine[o.doc_id][2] for o in out)
        assert sum(o.pi * o.size for o in out) == pytest.approx(sum(m[4] * m[2] for m in groups[g]))
        assert [o.settled for o in out] == [True] * (len(out) - 1) + [False]
        assert all(o.pi in (0.0, 1.0) for o in out[:-1])


def test_expected_copies(spark):
    """Over many pairs of two documents the mean of what each gets is its fraction."""
    n = 6000
    pair = lambda g: [(2 * g, 2 * g, 3, 0, 0.3, False), (2 * g + 1, 2 * g + 1, 5, 1, 0.6, False)]
    df = spark.createDataFrame([(g, pair(g)) for g in range(n)], "g int, m array<struct<h:long,doc_id:long,size:long,rid:long,pi:double,settled:boolean>>")
    mean = df.select(F.explode(settle(F.col("m"), 0)).alias("d")).groupBy("d.size").agg(F.avg("d.pi").alias("p")).collect()
    assert {r.size: round(r.p, 1) for r in mean} == {3: 0.3, 5: 0.6}
    assert all(abs(r.p - {3: 0.3, 5: 0.6}[r.size]) < 0.02 for r in mean)


def test_clashing_columns_pass_through(spark):
    df = spark.createDataFrame([(i, "a b c", "s" if i % 3 else "t", i, "h", -i, "x") for i in range(60)], "doc_id long, text string, source string, copy int, hashed string, k int, Times string")
    want = {r.doc_id: r.copies for r in mixed(df).collect()}
    got = resampled(df).collect()
    assert {i: n for i, n in want.items() if n} == {i: sum(r.doc_id == i for r in got) for i in {r.doc_id for r in got}}
    assert all((r.copy, r.hashed, r.k, r.Times) == (r.doc_id, "h", -r.doc_id, "x") for r in got)
