import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditweave.llm import forest, rulefit
from auditweave.llm.textstats import COUNTS, RATIOS, repeated_words, statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(t):
    words = WORD.findall(t)
    seen, dups = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(hit)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#é \x0b|", max_size=60))
def test_counts_match_brute_force(t):
    assert statistics(t)[0] == brute_counts(t)


def test_many_distinct_words_stay_exact():
    ids = np.concatenate([np.arange(20000), np.arange(100)])
    assert repeated_words(ids, 20000) == 200


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choices("aeinrst", k=rnd.randint(2, 8))) for _ in range(2000)]
    docs, labels = [], []
    for i in range(600):
        words = rnd.choices(vocabulary, k=rnd.randint(30, 200))
        bad = i % 6 == 0
        if bad:
            words = [w + rnd.choice(["###", "$$$"]) for w in words] if i % 12 else [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
        if i % 2 == 0 or i < 200:
            labels.append((i, 0 if bad else 1, 0))
    docs += [(600, ""), (601, None), (602, "a\nb\nb\nb"), (603, "long word " * 3000)]
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(docs)


def test_rule_ensemble_on_held_out_rows(corpus):
    docs, labels, texts = corpus
    rows = {r.doc_id: r for r in rulefit.quality_scores(docs, labels).collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [i for i, r in rows.items() if r.held_out and i < 600]
    assert np.mean([rows[i].predicted == (i % 6 != 0) for i in held]) > 0.97
    model = rulefit.fit(*forest.stats_sample(docs, labels, "quality", 4, 2))
    assert 0 < len(model.rules) < 120
    x = np.array([statistics(texts[i] or "")[1] for i in rows])
    assert np.allclose(model.score(x), [r.score for r in rows.values()])
    assert rulefit.quality_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in rulefit.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_labels_of_the_held_out_fold_are_not_used(spark, corpus):
    docs, labels, _ = corpus
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) as quality", "toxic")
    one, two = ({r.doc_id: r.score for r in rulefit.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_forest_keeps_clean_and_finds_anomalies(corpus):
    docs, labels, texts = corpus
    rows = {r.doc_id: r for r in forest.quality_rules(docs, labels).collect()}
    for i, r in rows.items():
        want = brute_counts(texts[i] or "") if i < 603 else statistics(texts[i])[0]
        assert [r[c] for c in COUNTS] == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    judged = [i for i in range(600) if not rows[i].base_failed]
    assert np.mean([rows[i].kept for i in judged if i % 6]) > 0.97
    assert np.mean([not rows[i].kept for i in judged if i % 6 == 0]) > 0.9
    assert forest.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_forest_scores_outliers_higher():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(RATIOS)))
    f = forest.IsolationForest(x)
    assert f.score(x[:1] * 0)[0] < f.score(x[:1] * 0 + 6)[0]
    assert forest.calibrated(np.array([0.1, 0.2, 0.9]), np.array([1, 1, 0])) == pytest.approx(0.55)
    assert forest.calibrated(np.array([0.5, 0.5]), np.array([1, 0])) == np.inf


def test_path_lengths_against_a_recursive_walk():
    """Each tree walked point by point; leaves hold depth plus the expected rest, cuts lie between the points that they part."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(5, 3)) + 8, np.zeros((20, 3))])
    f = forest.IsolationForest(x, trees=12, subsample=64)

    def depth(tree, point, at=0, d=0):
        feature, cut, child, length = tree
        if feature[at] < 0:
            return length[at], d
        return depth(tree, point, child[at] + int(point[feature[at]] >= cut[at]), d + 1)

    for k in range(0, len(x), 7):
        walks = [depth(t, x[k]) for t in f.trees]
        assert all(d <= 6 and total >= d for total, d in walks)
        assert f.score(x[k : k + 1])[0] == pytest.approx(2 ** (-np.mean([w[0] for w in walks]) / f.norm))
    for n in (2, 3, 10, 60):  # expected path of an unsuccessful search in a random binary tree, by its recurrence
        cost = [0.0, 0.0]
        for m in range(2, n + 1):
            cost.append(1 + sum(k / m * cost[k] + (m - k) / m * cost[m - k] for k in range(1, m)) / (m - 1))
        assert float(forest.mean_path(n)) == pytest.approx(cost[n], abs=0.12)


def test_threshold_against_all_cuts():
    rng = np.random.default_rng(4)
    for _ in range(30):
        scores = np.round(rng.random(60), 2)
        marks = (rng.random(60) < 0.7).astype(int)
        t = forest.calibrated(scores, marks, 3.0)
        gain = lambda c: (scores[marks == 0] > c).mean() - 3.0 * (scores[marks == 1] > c).mean()
        best = max([gain(c) for c in np.unique(scores)] + [0.0])
        assert (gain(t) if np.isfinite(t) else 0.0) == pytest.approx(best)


def test_labels_do_not_shape_the_forest(corpus):
    """Turning labels around moves the threshold only: anomaly scores stay."""
    docs, labels, _ = corpus
    turned = labels.selectExpr("doc_id", "1 - quality as quality", "toxic")
    one, two = ({r.doc_id: r.anomaly for r in forest.quality_rules(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_lasso_meets_its_optimality_conditions():
    """The fit's weights: gradient within the penalty where a rule is out, at the penalty where it is in."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, len(RATIOS)))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5) | (x[:, 5] > 1)).astype(int)
    model = rulefit.fit(x, y)
    p = model.score(x)
    assert np.mean((p >= 0.5) == y) > 0.95 and abs(np.mean(p - y)) < 1e-3
    for rule, weight in model.rules:
        z = rulefit.covers(rule, x).astype(float)
        slope = np.mean((p - y) * z) / z.std()
        assert slope == pytest.approx(-np.sign(weight) * rulefit.PENALTY, abs=1.5e-4)


def test_clashing_columns_pass_the_classifier(spark, corpus):
    docs, labels, _ = corpus
    odd = docs.withColumnRenamed("score", "stat_log_words").selectExpr("*", "'q' as _stat_log_words", "doc_id as Stat_repeat_share")
    want = {r.doc_id for r in rulefit.quality_scores(docs, labels).collect() if r.predicted}
    got = rulefit.accepted(odd, labels).collect()
    assert {r.doc_id for r in got} == want and all((r.stat_log_words, r._stat_log_words, r.Stat_repeat_share) == ("x", "q", r.doc_id) for r in got)
