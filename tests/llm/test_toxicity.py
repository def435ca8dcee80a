import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from auditweave.llm import toxicity as T


def brute_kernel(a, b):
    def phi(w):
        out = {}
        for at in combinations(range(len(w)), T.ORDER):
            k = "".join(w[i] for i in at)
            out[k] = out.get(k, 0) + T.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_against_brute_force():
    words = ["idiot", "idxiot", "banana", "aaaa", "abc", "worthless", "wérthless", "clown", "nwolc"]
    want = np.array([[brute_kernel(a, b) for b in words] for a in words])
    assert np.allclose(T.kernel(words, words), want)
    weights = np.arange(1.0, len(words) + 1)
    assert np.allclose(T.against(T.expand(words, weights), words), want @ weights)
    assert want[0, 1] > 0.5 > want[0, 2]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(8)
    insults = ["vermin", "halfwit", "nitwitted", "loathsome", "blockhead"]
    words = ["".join(rnd.choices("aeiounrstlmd", k=rnd.randint(3, 9))) for _ in range(1500)]
    docs, labels = [], []
    for i in range(900):
        text = rnd.choices(words, k=rnd.randint(15, 120))
        if i % 8 == 0:
            w = rnd.choice(insults)
            if i >= 600:
                k = rnd.randrange(1, len(w) - 1)
                w = rnd.choice([w, " ".join(w), w[:k] + "." + w[k:], w[:k] + "x" + w[k:], w.upper()])
            for _ in range(2):
                text.insert(rnd.randrange(len(text)), w)
        docs.append((i, " ".join(text), "x"))
        if i < 600:
            labels.append((i, 1, int(i % 8 == 0)))
    docs += [(2000, "", "x"), (2001, None, "x"), (2002, "z" * 5000, "x"), (3, docs[3][1], "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, predicted string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_held_out_accuracy_and_tolerance(corpus):
    docs, labels, texts = corpus
    rows = T.toxicity_scores(docs, labels).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows}
    for i, r in by.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    fresh = [r for r in rows if r.held_out and r.doc_id < 600 or 600 <= r.doc_id < 900]
    assert np.mean([r.predicted for r in fresh if r.doc_id % 8 == 0]) > 0.85
    assert np.mean([r.predicted for r in fresh if r.doc_id % 8]) < 0.03
    assert not by[2000].predicted and not by[2001].predicted
    assert T.toxicity_scores(docs.limit(0), labels).count() == 0
    assert len({r.score for r in T.toxicity_scores(docs, labels.limit(0)).collect()}) == 1


def test_landmark_projection_keeps_the_kernel():
    words = ["idiot", "idxiot", "banana", "worthless", "clown", "crown", "moron", "morons", "table", "stable", "fable"]
    points = T.kernel(words, words) @ T.whitening(words)
    want = np.array([[brute_kernel(a, b) for b in words] for a in words])
    assert np.allclose(points @ points.T, want, atol=1e-6)
    few = words[:6]  # off the landmarks the projection is the best approximation: never longer than the word itself
    part = T.kernel(words, few) @ T.whitening(few)
    assert (np.sum(part * part, 1) <= 1 + 1e-9).all() and np.allclose((part @ part.T)[:6, :6], want[:6, :6], atol=1e-6)


def test_machine_goes_to_the_minimum_and_equals_its_table(monkeypatch):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeioustrn"), 6)) for _ in range(60)]
    marks = np.where(np.array([w.count("a") for w in words]) > 0, 1.0, -1.0)
    weight = rng.random(60) + 0.1
    x = T.kernel(words, words[:20]) @ T.whitening(words[:20])
    early = T.svm(x, marks, weight)
    monkeypatch.setattr(T, "STEPS", 30000)
    w, bias = T.svm(x, marks, weight)
    cost = lambda v, b: float((weight / weight.sum() * np.maximum(1 - marks * (x @ v + b), 0) ** 2).sum() + T.RIDGE / 2 * v @ v)
    best = cost(w, bias)
    assert best <= cost(*early) < 1.1 * best  # the fit stops early, close by
    for _ in range(200):
        assert cost(w + rng.normal(size=len(w)) * 0.05, bias + rng.normal() * 0.05) >= best - 1e-6
    table = T.expand(words[:20], T.whitening(words[:20]) @ w)
    assert np.allclose(T.against(table, words), x @ w, atol=1e-6)
    assert np.allclose(T.against(table, words, T.prepared(words)), T.against(table, words, T.prepared(words, 100)))


def test_witness_is_the_largest_of_each_bag():
    rng = np.random.default_rng(3)
    bags, ids = np.sort(rng.integers(0, 40, 300)), rng.integers(0, 50, 300)
    values = np.round(rng.random(50), 1)
    got = T.best_of(bags, ids, values, 41)
    for b in range(41):
        own = ids[bags == b].tolist()
        assert got[b] == (min(own, key=lambda k: (-values[k], k)) if own else -1)


def test_long_texts_are_learnt_from(spark):
    """The only toxic sentences that teach an insult have more than 1,500 distinct words."""
    rnd = random.Random(2)
    words = ["".join(rnd.choices("aeiounrstlmd", k=rnd.randint(4, 9))) for _ in range(6000)]
    rows = [(i, " ".join(rnd.sample(words, 1800) + ["vermin"] * (i % 4 == 0))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (1000, "you vermin"), (1001, "you ve-rmin xx"), (1002, "nice words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in T.toxicity_scores(docs, labels).filter("doc_id >= 1000").collect()}
    assert got == {1000: 1, 1001: 1, 1002: 0}
