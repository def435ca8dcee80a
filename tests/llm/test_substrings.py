import hashlib
import random
import re

import numpy as np

from auditweave.llm import blocks as B
from auditweave.llm.substrings import COVER, PERIOD, removed_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - 12) if i is not None else []:
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = {j for k in range(len(w) - 12) if i is not None and least[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def test_cover_aligns_any_two_positions():
    assert all(any((i + k) % PERIOD in COVER and (j + k) % PERIOD in COVER for k in range(PERIOD)) for i in range(PERIOD) for j in range(PERIOD))


def test_word_hashes_follow_the_words():
    texts = ["a b  a", "", "\x0bé\x1c\xa0x a", "b" * 300 + " b"]
    h, counts = B.word_hashes([t.encode() for t in texts])
    words = [w for t in texts for w in WORD.findall(t)]
    assert counts.tolist() == [len(WORD.findall(t)) for t in texts] and len(h) == len(words)
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    assert np.array_equal(B.word_hashes([b"AbC"], True)[0], B.word_hashes([b"abc"])[0])


def test_against_brute_force(spark):
    rnd = random.Random(2)
    passages = [[f"p{k}w{j}" for j in range(rnd.randint(11, 60))] for k in range(6)]
    rows = []
    for i in range(300):
        w = [f"u{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 5)
            w[rnd.randint(0, len(w)) :][:0] = []
            at = rnd.randint(0, len(w))
            w = w[:at] + p[a : rnd.randint(len(p) - 4, len(p))] + w[at:]
        rows.append((rnd.randint(-50, 10**6), rnd.choice([" ", "\n", "  "]).join(w)))
    rows += [(7, rows[0][1]), (7, rows[0][1]), (None, rows[1][1]), (8, None), (9, ""), (11, "same " * 500), (12, "same " * 40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(5)
    got = removed_passages(df, keep_text=True).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert removed_passages(df.limit(0)).count() == 0


def test_very_long_text(spark):
    """A text of 400,000 words that shares one passage with a short one, and repeats the short one's words elsewhere."""
    rnd = random.Random(4)
    passage = " ".join(f"p{j}" for j in range(40))
    long = [f"u{rnd.randint(0, 10**7)}" for _ in range(400_000)]
    rows = [(5, " ".join(long[:250_000]) + " " + passage + "\n" + " ".join(long[250_000:])), (3, "a " + passage), (9, None)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in removed_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (n, k, sha) for i, n, k, sha in brute(rows)} and got[5][1] == 40
