"""Periodic runs of words, by longest previous factors.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends, at least twice q long.
For the words of a text, ranks by prefix doubling give the suffix array and, level by level, the longest common extension of
any two places. Neighbours in the suffix array give the LCP array; deleting places from the last to the first out of the list
of neighbours turns it into the longest previous factor of every place (and where that factor was). Cutting the text greedily
by these factors gives its Lempel-Ziv blocks. Every run either touches the beginning of a block or lies strictly inside one:

* Runs at a block's beginning are found by Main's extensions: for each period up to the length of the two blocks that meet,
  extend to both sides at one period's distance. A run whose last word lies in a block begins less than a period before the
  block before it ends, or the block before it would have taken it whole, so longer periods cannot occur.
* A block has occurred before, so runs strictly inside it are copies of runs inside the earlier occurrence. Runs are kept in
  buckets by their first word; a block reads the buckets of its source from left to right, which also serves a block that
  overlaps its source.

A run of 12 words or more repeats six consecutive words, so texts without a repeated six-word window (hashes of all windows,
which never miss one) have none and skip the construction. Texts are worked on in chunks of ``CHUNK`` words, each text with
an alphabet of its own, so that nothing crosses from one text to the next; a longer text is a chunk by itself (some 400
bytes a word). Everything is inside one text, so the operator has no shuffle.

Edge cases: a null or empty text has no words, no runs and an empty collapsed text; a null id is carried through; ties for
the longest run go to the smallest start, then the smallest period; repeated rows get equal rows; an empty table gives an
empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.arrowio import bounded_batches, id_text

LEAST = 12
CHUNK = 1 << 17
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
MIX = np.random.default_rng(20250613).integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class Extensions:
    """Longest common extensions to the right of any two different places of a sequence."""

    def __init__(self, x: np.ndarray):
        n = self.n = len(x)
        rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
        self.levels, width = [], 1
        while True:
            self.levels.append(np.append(rank, -1).astype(np.int32))
            if n == 0 or int(rank.max()) == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: max(n - width, 0)] = rank[width:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            width *= 2
        self.rank = rank

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal ranks mean a whole equal power of two: two different suffixes that end sooner differ in length."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            out += (level[i + out] == level[j + out]).astype(np.int64) << k
        return out


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """Longest previous factor of every place, and a place where it occurred (-1: none). lcp[r]: of order[r - 1] and order[r]."""
    n = len(order)
    left, right, near = list(range(-1, n - 1)), list(range(1, n + 1)), [*lcp.tolist(), 0]
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    at, ranks = order.tolist(), rank.tolist()
    longest, source = [0] * n, [-1] * n
    for place in range(n - 1, -1, -1):
        r = ranks[place]
        a, b = left[r], right[r]
        before, behind = near[r], near[b]
        if before >= behind:
            if before:
                longest[place], source[place] = before, at[a]
            near[b] = behind
        else:
            longest[place], source[place] = behind, at[b]
            near[b] = before
        if a >= 0:
            right[a] = b
        if b < n:
            left[b] = a
    return longest, source


def blocks(longest: list[int]) -> list[tuple[int, int]]:
    """Lempel-Ziv blocks as (start, end)."""
    out, at, n = [], 0, len(longest)
    while at < n:
        end = at + (longest[at] or 1)
        out.append((at, end))
        at = end
    return out


def runs_at_borders(n: int, cut: list[tuple[int, int]], ahead: Extensions, behind: Extensions, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of ``least`` words or more that touch a block's beginning or the end, by Main's extensions."""
    edges = np.array([0, *(e for _, e in cut)], np.int64)
    lengths = np.diff(edges)
    reach = np.minimum(lengths + np.append(lengths[1:], 0), n)
    border = np.repeat(edges[1:], reach)
    q = np.arange(len(border)) - np.repeat(np.cumsum(reach) - reach, reach) + 1
    found = []
    for first, second in ((border, border + q), (border - q, border)):
        ok = (first >= 0) & (second <= n)
        i, j, p = first[ok], second[ok], q[ok]
        more = ahead(i, j)
        less = behind(n - i, n - j)
        good = (less + more >= p) & (less + more + p >= least)
        found.append(np.stack([i[good] - less[good], j[good] + more[good], p[good]], 1))
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    fresh = np.ones(len(every), bool)
    fresh[1:] = (every[1:, :2] != every[:-1, :2]).any(1)  # a multiple of the smallest period has the same ends
    return list(map(tuple, every[fresh].tolist()))


def all_runs(x: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of ``least`` items or more, by start, then period."""
    n = len(x)
    if n < least:
        return []
    ahead, behind = Extensions(x), Extensions(x[::-1])
    order = np.empty(n, np.int64)
    order[ahead.rank] = np.arange(n)
    lcp = np.append(0, ahead(order[:-1], order[1:]))
    longest, source = previous_factors(order, lcp)
    cut = blocks(longest)
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for s, e, q in runs_at_borders(n, cut, ahead, behind, least):
        buckets[s].append((e, q))
    for b, f in cut:
        if f - b < least + 2:
            continue
        back = b - source[b]
        for s in range(source[b] + 1, f - back - least):
            for e, q in buckets.get(s, ()):
                if e < f - back:
                    buckets[s + back].append((e + back, q))
    return sorted((s, e, q) for s, found in buckets.items() for e, q in found)


def repeats_within(ids: np.ndarray, owner: np.ndarray, n_texts: int, width: int) -> np.ndarray:
    """Which texts have a window of ``width`` items twice (texts of equal window hashes count too)."""
    n = len(ids) - width + 1
    found = np.zeros(n_texts, bool)
    if n < 2:
        return found
    h = owner[:n].astype(np.uint64) * MIX[63]
    for k in range(width):
        h += (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * MIX[k]
    h = (h ^ (h >> np.uint64(32))) * MIX[62]
    inside = np.flatnonzero(owner[:n] == owner[width - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    twice = h[order[1:]] == h[order[:-1]]
    found[owner[order[1:][twice]]] = True
    return found


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, (start, end, period)."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    chosen = repeats_within(ids, owner, len(texts), max(least // 2, 1))
    mine = chosen[owner]
    starts = np.cumsum(np.where(chosen, sizes, 0)) - np.where(chosen, sizes, 0)
    owner = owner[mine]
    for s, e, q in all_runs(owner * len(number) + ids[mine], least):
        k = int(owner[s])
        out[k].append((s - int(starts[k]), e - int(starts[k]), q))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, e, q in runs:
        edge[s + q] += 1
        edge[e] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row: doc_id, n_words, runs (by start, then period) and the text's words without repetitions, joined by blanks."""

    def part(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of_texts(texts, least)
        shown = pa.array([[{"start": s, "length": e - s, "period": q} for s, e, q in r] for r in runs], RUNS)
        collapsed = pa.array([b" ".join(kept_words(t, r)) for t, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), shown, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, size = [], 0, 0
            for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = text.split()
                if texts and size + len(words) > CHUNK:
                    yield part(batch.column(0).slice(first, len(texts)), texts)
                    texts, first, size = [], k, 0
                texts.append(words)
                size += len(words)
            if texts:
                yield part(batch.column(0).slice(first, len(texts)), texts)

    return bounded_batches(id_text(docs, id_col, text_col)).mapInArrow(run, SCHEMA)


def _bind(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text; the words of every tenth text (by crc32 of the decimal id) repeat with one period from some word on."""
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chosen = (F.coalesce(h % 10, F.lit(1)) == 0) & F.regexp_like(text, F.lit(WORD))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(chosen, _bind(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), repeated)).otherwise(text).alias("text"))


def run_digest(runs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_runs, the longest run, digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    rows = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("b.length"), -F.col("b.period")
    return rows.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
