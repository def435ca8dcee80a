"""Personal data: base spans against the plain expressions, labelers and classifier against known truth."""

import hashlib
import random
import re
import time

import numpy as np

from auditweave.llm import pii
from auditweave.llm.pii import KINDS, candidates, luhn, personal_data, personal_digest, reliabilities


def plain(t):
    """The base by the expressions as they are given."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    number = lambda x: re.sub("[^0-9]", "", x)
    checks = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(number(m.group())) <= 19 and checks(number(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(number(m.group())) <= 15]
    return sorted(out)


def card(rng, n=16):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(head + d for d in "0123456789" if luhn(head + d))


def test_base_equals_the_expressions():
    rng = random.Random(5)
    pieces = ["a", "b.c", "@", "@", ".", "-", "_", "%", "+", "1", "12", "255", "256", "007", " ", "(", ")", "4111111111111111", "\n", "é", "x@y.z", "10.0.0.1", "+1 (555) 123-4567", "1.2.3.4.5.6.7.8", "..", "@@"]
    for _ in range(20_000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        assert [x for x in candidates(t) if x[1] < 4] == plain(t), t


def test_long_runs_take_linear_time():
    n = 400_000
    began = time.time()
    for t in ["a" * n, "1" * n, "1." * n, "a@" * n, "a.b-c_" * n, "1-" * n, "+1 " * n, "+1" + "(" * n, "(12) " * n, "AB12 " * n, "Dr. " * n, "a (at) " * n, "Anna " * n, "@" * n, "a.a@a.a" * n]:
        candidates(t)
    assert time.time() - began < 60


def test_reliabilities_of_known_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(40_000) < 0.3
    accuracy = np.array([0.95, 0.7, 0.85, 0.6])
    votes = np.where(rng.random((len(truth), 4)) < accuracy, 1, -1) * np.where(truth, 1, -1)[:, None]
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, right, wrong = reliabilities(patterns, counts.astype(float))
    assert np.abs(right - accuracy).max() < 0.05 and np.abs(wrong - accuracy).max() < 0.05
    assert abs((share * counts).sum() / counts.sum() - 0.3) < 0.03


def corpus(seed=2):
    rng = random.Random(seed)
    words = "der die una la the of and que est ung tion heit".split()
    rows, planted, decoys = [], {}, {}
    for i in range(600):
        text = [rng.choice(words) for _ in range(30)]
        what = i % 7
        span = {0: f"{rng.choice(words)}.{i}(at)mail{i}(dot)com", 1: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}", 2: f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", 3: "Dr. " + rng.choice(["Anna Weber", "Peter Smith"]), 4: f"1999-{rng.randrange(10000, 99999)}", 6: "41" + "".join(rng.choice("13579") for _ in range(13)) + "8", 5: f"+1 (555) 555-{rng.randrange(1000, 9999)} and x{i}@mail.com and {card(rng)} and 10.2.3.4"}[what]
        cue = {0: "mail", 1: "phone", 2: "SSN", 3: "signed", 4: "order", 5: "and", 6: "and"}[what]
        if what == 6 and luhn(span):
            span = span[:-1] + "9"
        text[10:11] = [cue, span]
        (planted if what < 4 else decoys)[i] = span
        rows.append((i, " ".join(text)))
    return rows, planted, decoys


def test_added_spans(spark):
    rows, planted, decoys = corpus()
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    shown = {i: [texts[i][s.start : s.end] for s in r.added] for i, r in got.items()}
    hit = sum(shown[i] == [x] for i, x in planted.items())
    assert hit >= 0.95 * len(planted)
    assert not any(shown[i] for i in decoys)


def test_query(spark):
    rng = random.Random(1)
    rows = [(None, "a@b.cc", "x"), (1, None, "x"), (2, "", "x"), (3, "é a@b.cc 1.2.3.4 " * 3000, "x"), (4, f"{card(rng)}@b.cc", "x"), (4, f"{card(rng)}@b.cc", "x"), (5, "+1 (555) 123-4567" * 2, "y")] + [(9 + i, t, "z") for i, t in corpus(3)[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = personal_digest(df).collect()
    want = []
    for i, t, _ in rows:
        base = plain(t or "")
        spelled = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        want.append((i, *(sum(x[1] == k for x in base) for k in range(4)), hashlib.sha256(spelled.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        spans = [x for x in r.spans.split(",") if x]
        assert len(spans) - sum(tuple(r)[1:5]) == r.n_added
        order = [(int(x.split(":")[1]), KINDS.index(x.split(":")[0])) for x in spans]
        assert order == sorted(order)
    assert personal_digest(df.limit(0)).count() == 0


def test_compiled_score_equals_the_model(spark):
    rows, *_ = corpus(4)
    spans = pii.labelled(spark.createDataFrame(rows, "doc_id long, text string"))
    weights = pii.fitted(spans)
    from pyspark.sql import functions as F

    got = spans.select(F.explode("spans").alias("s")).select("s.kind", "s.pattern", pii.score(F.col("s"), weights).alias("p")).distinct().collect()
    x = pii.inputs(np.array([r.kind for r in got]), np.array([r.pattern for r in got]))
    assert np.allclose(1 / (1 + np.exp(-(x @ weights))), [r.p for r in got])
