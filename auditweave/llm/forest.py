"""Quality rules with an isolation forest over rule statistics.

Base rules reject very short and very repetitive texts. The rest are judged by an isolation forest over the raw statistics
of the rules that the base leaves open (``RULES``: symbols and exclamation marks to words, share of the most frequent word, share of distinct
words, length of words): random splits isolate rule violations after few steps, and the mean path length over the trees
gives the anomaly score. The forest sees no labels: it is grown on every row that passes the base rules, as they come, level
by level: each pass over the statistics (the texts are read once) gives the extremes and the number of rows of all nodes of
a level, so cuts and path lengths come from all rows, whatever their number. Labels only calibrate the threshold, over all
labelled rows that pass: the one that separates the two best, where the share of clean rows lost weighs ``CLEAN_WEIGHT``
times the share of bad rows found. Without labelled rows of both kinds nothing is rejected beyond the base rules.

Edge cases: null and empty texts have zero statistics and fail the base rules; a text of any length is judged whole;
repeated rows and rows with equal statistics (ties) get equal verdicts; repeated rows of a doc_id weigh once in the threshold; an empty table gives an empty table; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.arrowio import bounded_batches, id_text, map_texts
from auditweave.llm.labelled import MAX_ROWS, labelled_sample
from auditweave.llm.mixing import running
from auditweave.llm.shared import cut as stored
from auditweave.llm.textstats import COUNTS, RATIOS, statistics

#: Shallow trees keep bad rows from hiding one another: what is left in a leaf counts by its number of rows.
TREES, DEPTH, SUBSAMPLE, CLEAN_WEIGHT, SEED = 200, 5, 32, 20.0, 7
RULES = ("symbols_per_word", "bangs_per_word", "top_word_share", "distinct_share", "word_length")


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points: 2 H(n - 1) - 2 (n - 1) / n."""
    n = np.asarray(n, float)
    i = np.maximum(n - 1, 1)
    harmonic = np.log(i) + 0.5772156649015329 + 1 / (2 * i) - 1 / (12 * i * i)
    return np.where(n > 2, 2 * harmonic - 2 * i / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Flat arrays for each tree: feature (-1 at a leaf), cut, left child (right is the next), leaf path length.

    Grown on subsamples of points at hand, or ``over`` all rows of a table."""

    def __init__(self, points: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.norm = float(mean_path(min(subsample, len(points)))) or 1.0
        limit = int(np.ceil(np.log2(max(min(subsample, len(points)), 2))))
        self.trees = []
        for _ in range(trees):
            own = points[rng.permutation(len(points))[:subsample]]
            feature, cut, child, length = [0], [0.0], [0], [0.0]
            todo = [(0, own, 0)]
            while todo:
                at, x, depth = todo.pop()
                low, high = x.min(0), x.max(0)
                free = np.flatnonzero(high > low)
                if depth >= limit or len(x) < 2 or not len(free):
                    feature[at], length[at] = -1, depth + float(mean_path(len(x)))
                    continue
                f = int(rng.choice(free))
                c = float(rng.uniform(low[f], high[f]))
                feature[at], cut[at], child[at] = f, c, len(feature)
                for side in (x[x[:, f] < c], x[x[:, f] >= c]):
                    todo.append((len(feature), side, depth + 1)) if len(side) else None
                    feature.append(-1), cut.append(0.0), child.append(0), length.append(float(depth + 1))
            self.trees.append(tuple(np.array(v) for v in (feature, cut, child, length)))

    @classmethod
    def over(cls, rows: DataFrame, columns: tuple[str, ...], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> "IsolationForest | None":
        """Grown on every row, a pass for each level; None without rows."""
        self = cls.__new__(cls)
        random = [np.random.default_rng((seed, t)) for t in range(trees)]
        grown = [([-1], [0.0], [0], [0.0]) for _ in range(trees)]
        live = [[0] for _ in range(trees)]
        for d in range(depth + 1):
            self.trees = [tuple(np.array(v) for v in tree) for tree in grown]
            reached = self.reached(rows, columns, live, d < depth)
            if not reached:
                return None
            if d == 0:
                self.norm = float(mean_path(reached[0, 0][0])) or 1.0
            following: list[list[int]] = [[] for _ in range(trees)]
            for t, (feature, cut, child, length) in enumerate(grown):
                for at in live[t]:
                    n, low, high = reached[t, at]
                    free = np.flatnonzero(high > low)
                    if not len(free):
                        length[at] = d + float(mean_path(n))
                        continue
                    f = int(random[t].choice(free))
                    c = float(random[t].uniform(low[f], high[f]))
                    feature[at], cut[at], child[at] = f, c if c > low[f] else float(high[f]), len(feature)
                    following[t] += [len(feature), len(feature) + 1]
                    for v, new in zip((feature, cut, child, length), (-1, 0.0, 0, 0.0), strict=True):
                        v += [new, new]
            live = following
            if not any(live):
                break
        self.trees = [tuple(np.array(v) for v in tree) for tree in grown]
        return self

    def reached(self, rows: DataFrame, columns: tuple[str, ...], live: list[list[int]], split: bool) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
        """Number of rows, least and greatest values at each live node of each tree; of nodes that are not split the number alone."""
        k, trees, ends = len(columns), self.trees, self.ends
        slots = [np.full(len(tree[0]), -1) for tree in trees]
        for slot, nodes in zip(slots, live, strict=True):
            slot[nodes] = np.arange(len(nodes))
        width = max(map(len, live))

        def run(batches):
            n, low, high = np.zeros((len(trees), width), np.int64), np.full((len(trees), width, k), np.inf), np.full((len(trees), width, k), -np.inf)
            for b in batches:
                x = np.column_stack([c.to_numpy() for c in b.columns])
                for t, slot in enumerate(slots):
                    s = slot[ends(trees[t], x)]
                    n[t] += np.bincount(s[s >= 0], minlength=width)
                    if split and len(s):
                        order = np.argsort(s, kind="stable")
                        s, first = np.unique(s[order], return_index=True)
                        here = s >= 0
                        low[t, s[here]] = np.minimum(low[t, s[here]], np.minimum.reduceat(x[order], first)[here])
                        high[t, s[here]] = np.maximum(high[t, s[here]], np.maximum.reduceat(x[order], first)[here])
            t, s = np.nonzero(n)
            at = np.array([live[a][b] for a, b in zip(t, s, strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (t, at, n[t, s], *low[t, s].T, *high[t, s].T)], names)

        names = ["tree", "node", "n", *(f"low{j}" for j in range(k)), *(f"high{j}" for j in range(k))]
        each = bounded_batches(rows.select(*columns)).mapInArrow(run, "tree long, node long, n long, " + ", ".join(f"{c} double" for c in names[3:]))
        total = each.groupBy("tree", "node").agg(F.sum("n"), *(F.min(c) for c in names[3 : 3 + k]), *(F.max(c) for c in names[3 + k :]))
        return {(r[0], r[1]): (r[2], np.array(r[3 : 3 + k]), np.array(r[3 + k :])) for r in total.collect()}  # trees x 2^depth rows at most

    @staticmethod
    def ends(tree: tuple[np.ndarray, ...], points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        feature, cut, child, _ = tree
        at, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        while (inner := feature[at] >= 0).any():
            f = np.maximum(feature[at], 0)
            at = np.where(inner, child[at] + (points[rows, f] >= cut[at]), at)
        return at

    def score(self, points: np.ndarray) -> np.ndarray:
        """0 to 1, higher: more anomalous."""
        total = np.zeros(len(points))
        for tree in self.trees:
            total += tree[3][self.ends(tree, points)]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def rule_statistics(ratios: np.ndarray) -> np.ndarray:
    return ratios[:, [RATIOS.index(r) for r in RULES]]


def calibrated(scores: np.ndarray, labels: np.ndarray, clean_weight: float = CLEAN_WEIGHT) -> float:
    """The threshold above which rows are rejected; scores of clean and bad rows in any order, ties kept together."""
    if not (labels == 1).any() or not (labels == 0).any():
        return np.inf
    cuts = np.unique(scores)
    bad, clean = np.sort(scores[labels == 0]), np.sort(scores[labels == 1])
    gain = (1 - np.searchsorted(bad, cuts, "right") / len(bad)) - clean_weight * (1 - np.searchsorted(clean, cuts, "right") / len(clean))
    k = int(np.flatnonzero(gain == gain.max())[-1])
    return float(cuts[k] if k + 1 == len(cuts) else (cuts[k] + cuts[k + 1]) / 2) if gain[k] > 0 else np.inf


def threshold(scored: DataFrame, clean_weight: float = CLEAN_WEIGHT) -> float:
    """``calibrated`` over all rows (anomaly, label) of a table: rows by score, and running sums over them."""
    marks = scored.groupBy("anomaly").agg(*(F.sum((F.col("label") == v).cast("long")).alias(k) for k, v in (("bad", 0), ("clean", 1)))).filter("bad + clean > 0")
    marks = stored(marks)
    bad, clean = marks.agg(F.sum("bad"), F.sum("clean")).first()
    if not bad or not clean:
        return np.inf
    sums = running(marks, [F.col("anomaly")], bad_before=F.col("bad"), clean_before=F.col("clean"))
    gain = (1 - (F.col("bad_before") + F.col("bad")) / bad) - clean_weight * (1 - (F.col("clean_before") + F.col("clean")) / clean)
    best = sums.agg(F.max(F.struct(gain.alias("gain"), "anomaly")).alias("m")).select("m.*").first()
    if best.gain <= 0:
        return np.inf
    return (best.anomaly + marks.filter(F.col("anomaly") > best.anomaly).agg(F.min("anomaly")).first()[0]) / 2


def stats_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int | None = None, held: int | None = None, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Ratios and labels of the sample, in order of doc_id; repeated rows of a doc_id count once (the smallest)."""
    names = ", ".join(f"{r} double" for r in RATIOS)

    def run(batches):
        for b in batches:
            got = [statistics(t)[1] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([g[k] for g in got], pa.float64()) for k in range(len(RATIOS)))], ["doc_id", "label", *RATIOS])

    rows = bounded_batches(labelled_sample(docs, labels, label, folds, held, max_rows)).mapInArrow(run, f"doc_id long, label int, {names}")
    got = rows.groupBy("doc_id").agg(F.min(F.struct("label", *RATIOS)).alias("s")).select("doc_id", "s.*").toPandas().sort_values("doc_id")
    return got[RATIOS].to_numpy(float), got["label"].to_numpy(int)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Per row: the base statistics, base_failed, kept, and the forest's anomaly score."""

    def measure():
        def work(texts):
            got = [statistics(t) for t in texts]
            counts = np.array([g[0] for g in got], np.int64)
            failed = (counts[:, 0] < min_words) | (100 * counts[:, 4] > max_repeat_percent * counts[:, 0])
            return [*counts.T, failed, *rule_statistics(np.array([g[1] for g in got], float)).T]

        return work

    long, double = pa.int64(), pa.float64()
    schema = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean"
    names = [*COUNTS, "base_failed", *RULES]
    rows = map_texts(id_text(docs, id_col, text_col), measure, schema + "".join(f", {r} double" for r in RULES), names, [*[long] * 5, pa.bool_(), *[double] * len(RULES)])
    rows = stored(rows)
    forest = IsolationForest.over(rows.filter("not base_failed"), RULES)
    kept_columns = ["doc_id", *COUNTS, "base_failed"]

    def judge(batches):
        for b in batches:
            if b.num_rows:
                points = np.column_stack([b.column(r).to_numpy() for r in RULES])
                anomaly = forest.score(points) if forest else np.zeros(len(points))
                yield pa.RecordBatch.from_arrays([*map(b.column, kept_columns), pa.array(anomaly)], [*kept_columns, "anomaly"])

    scored = stored(bounded_batches(rows).mapInArrow(judge, f"doc_id long, {schema}, anomaly double"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    limit = threshold(scored.filter("not base_failed").groupBy("doc_id").agg(F.min("anomaly").alias("anomaly")).join(known, "doc_id"))
    return scored.select(*kept_columns, (~F.col("base_failed") & (F.col("anomaly") <= float(limit))).alias("kept"), "anomaly")
