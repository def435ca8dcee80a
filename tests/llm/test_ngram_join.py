import random
import re

import pytest

from auditweave.llm import ngram_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d is None, d or 0, len(s), low[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near_copies(rnd, n, size, most):
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, most)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
        yield " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    passage = " ".join(f"common{j}" for j in range(25))
    texts = []
    for _ in range(25):
        texts += near_copies(rnd, rnd.randint(1, 7), rnd.choice([6, 20, 40, 90, 200]), rnd.choice([0, 1, 2, 5]))
    texts += near_copies(rnd, 120, 60, 2)
    texts += [passage + " " + " ".join(f"s{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 8))) for _ in range(90)]
    texts += ["a b", "A  b", "a", "", None, "x y z q", "same words " * 300, "same words " * 200, "a b c d e", "A B C D E\n"]
    texts += [texts[3], texts[40], texts[40], texts[100].upper()]
    ids = rnd.sample(range(10**6), len(texts))
    return list(zip(ids, texts, strict=True)) + [(None, texts[0]), (ids[5], texts[5])]


def test_components_against_all_pairs(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(6)
    want = brute(rows)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id)
    assert sorted(map(key, J.near_duplicates(df).collect()), key=repr) == want
    monkeypatch.setattr(J, "CAP", 16)  # large groups in pairs of parts
    assert sorted(map(key, J.near_duplicates(df).collect()), key=repr) == want
    assert J.near_duplicates(df.limit(0)).count() == 0


def test_trees_lose_no_link(rows):
    import numpy as np

    rnd = random.Random(1)
    sets = [np.array(sorted({hash(x) & (2**64 - 1) for x in shingles(t)}), np.uint64) for _, t in rows]
    sets = [s for s in sets if len(s)]
    group = [(0, k, k, len(s), s.tobytes()) for k, s in enumerate(sets)]
    rnd.shuffle(group)
    links = {(i, j) for i in range(len(sets)) for j in range(i) if J.may_link(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    got = J.searched(group, 80, True)
    assert set(got) <= links and len(got) < len(sets)
    assert classes(len(sets), got) == classes(len(sets), links)
    tested = sum(1 for _ in J.dual(*[J.tree(nodes(group))] * 2, 80, lambda a, b: a == b))
    assert len(links) <= tested < len(sets) ** 2 / 8
    half = [(k % 2, *g[1:]) for k, g in enumerate(group)]
    side = {g[1]: g[0] for g in half}
    assert classes(len(sets), J.searched(half, 80, False)) == classes(len(sets), [p for p in links if side[p[0]] != side[p[1]]])


def nodes(group):
    out = []
    for _, rep, comp, n, raw in group:
        bits = sum({1 << (int.from_bytes(raw[i : i + 8], "little") >> 8) % 1024 for i in range(0, len(raw), 8)})
        out.append(J.Node(bits, n, n, n, n - bits.bit_count(), comp, rep))
    return out


def classes(n, pairs):
    root = list(range(n))
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    return {frozenset(i for i in range(n) if root[i] == r) for r in root}


def test_one_row_of_each_component_and_clashing_columns(spark, rows):
    df = spark.createDataFrame([(*r, k, "p") for k, r in enumerate(rows)], "doc_id long, text string, leaving long, _place string").repartition(4)
    got = J.deduplicated(df).collect()
    low = {d: c for _, d, _, c in brute(rows) if c is not None}
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(d for d, c in low.items() if d == c)
    assert all(rows[r.leaving] == (r.doc_id, r.text) and r._place == "p" for r in got)
