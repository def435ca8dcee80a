"""The forest and its threshold over whole tables, held against walks and sorts of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditweave.llm import forest


def test_every_row_counts_in_every_tree(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(900, 2)), rng.normal(size=(9, 2)) + 7, np.zeros((40, 2))])
    df = spark.createDataFrame(x.tolist(), "a double, b double").repartition(5)
    f = forest.IsolationForest.over(df, ("a", "b"), trees=9, depth=4)
    assert f.norm == pytest.approx(float(forest.mean_path(len(x))))

    def walk(tree, at, points, depth):
        feature, cut, child, length = tree
        if feature[at] < 0:
            assert depth == 4 or len(points) == 1 or (points == points[0]).all()
            assert length[at] == pytest.approx(depth + float(forest.mean_path(len(points))))
            return len(points)
        v = points[:, feature[at]]
        assert v.min() < cut[at] <= v.max()
        return sum(walk(tree, child[at] + side, points[(v >= cut[at]) == side], depth + 1) for side in (0, 1))

    assert all(walk(t, 0, x, 0) == len(x) for t in f.trees)
    assert [t[1].tolist() for t in f.trees] == [t[1].tolist() for t in forest.IsolationForest.over(df.repartition(2), ("a", "b"), trees=9, depth=4).trees]
    assert forest.IsolationForest.over(df.limit(0), ("a", "b")) is None


def test_threshold_of_a_table(spark):
    rng = np.random.default_rng(6)
    for k in range(4):
        scores, marks = np.round(rng.random(80), 2), (rng.random(80) < 0.7).astype(int)
        df = spark.createDataFrame(list(zip(scores.tolist(), marks.tolist(), strict=True)), "anomaly double, label int").repartition(3)
        assert forest.threshold(df, 0.5 + k) == pytest.approx(forest.calibrated(scores, marks, 0.5 + k))
    assert forest.threshold(df.filter("label = 1")) == np.inf


def test_labelled_rows_beyond_any_sample_move_the_threshold(spark):
    """Clean rows as noisy as bad ones, all among the last ids of the order that samples are taken in."""
    n = 8400
    last = {r.id for r in spark.range(n).orderBy(F.xxhash64("id").desc()).limit(300).collect()}
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choices("aeinrst", k=rnd.randint(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = rnd.sample(vocabulary, rnd.randint(12, 30))
        bad = i % 20 == 0 and i not in last
        docs.append((i, " ".join(w + "#" * rnd.randint(1, 4) for w in words) if bad or i in last else " ".join(words)))
        labels.append((i, 0 if bad else 1))
    rows = forest.quality_rules(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    marks, judged = dict(labels), [r for r in rows if not r.base_failed]
    best = forest.calibrated(np.array([r.anomaly for r in judged]), np.array([marks[r.doc_id] for r in judged]))
    assert len(rows) == n and all(r.kept == (r.anomaly <= best) for r in judged)
