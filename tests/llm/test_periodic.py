"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from auditweave.llm.periodic import all_runs, kept_words, periodic_runs, run_digest, runs_of_texts, with_repeats


def plain(x, least=12):
    """Every maximal stretch of each period, smallest periods first; a stretch whose ends are known has a smaller period."""
    seen = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                seen.setdefault((i, j + q), q)
            i = j
    return sorted((s, e, q) for (s, e), q in seen.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_sequences(letters):
    rng = random.Random(letters)
    for _ in range(150):
        x = [rng.randrange(letters) for _ in range(rng.randrange(0, 90))]
        if rng.random() < 0.5 and x:
            unit = x[: rng.randrange(1, 20)]
            x += unit * rng.randrange(1, 6) + x[::-1] + unit * 3
        for least in (2, 5, 12):
            assert all_runs(np.array(x, np.int64), least) == plain(x, least)


@pytest.mark.parametrize("text", [fibonacci(400), "a" * 300, ("ab" * 9 + "c") * 12, ("ab" * 8 + "cd" * 8) * 5 + "e" + ("ab" * 8 + "cd" * 8) * 5, "abcabcabcabcabcd" * 6 + "x" + "bcabcabcabcabc" * 3])
def test_structured_sequences(text):
    x = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    for least in (2, 12):
        assert all_runs(x, least) == plain(x.tolist(), least)


def test_texts_do_not_touch():
    texts = [b"a b".split() * 4, b"a b".split() * 4, [], b"x".split() * 30, b"one two three four five six".split() * 2, [b"b"] + b"a b".split() * 6]
    assert runs_of_texts(texts) == [plain(t) for t in texts] == [[], [], [], [(0, 30, 1)], [(0, 12, 6)], [(0, 13, 2)]]


def test_kept_words():
    assert kept_words(b"a b a b a b a b a b a b c".split(), [(0, 12, 2)]) == [b"a", b"b", b"c"]


def expected(doc_id, text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    dropped = {i for s, e, q in runs for i in range(s + q, e)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shown = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    return (doc_id, len(runs), *shown, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_against_plain_search(spark):
    rng = random.Random(7)
    texts = [None, "", " \t\n", "é é " * 20, "x " * 2000, "one two \x0bthree\x1cfour " * 8]
    for _ in range(150):
        words = [rng.choice(["der", "die", "das", "una", "la"]) for _ in range(rng.randrange(1, 120))]
        if rng.random() < 0.6:
            words += words[: rng.randrange(1, 9)] * rng.randrange(2, 7)
        texts.append(" ".join(words))
    rows = [(i, t, f"c{i}") for i, t in enumerate(texts)] + [(None, "a b " * 9, "n"), (5, texts[5], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = run_digest(periodic_runs(with_repeats(df))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(i, t) for i, t, _ in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows[:-2])
    assert run_digest(periodic_runs(with_repeats(df.limit(0)))).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    text = " ".join(base + base[:9] * 40 + base)
    [row] = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    [r] = row.runs
    assert (r.period, r.start <= 200_000, r.length >= 369) == (9, True, True)
    assert len(row.collapsed.split()) == 400_360 - r.length + 9
