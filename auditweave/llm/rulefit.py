"""Quality classifier: a sparse ensemble of conjunctive rules, compiled into Spark column expressions.

Shallow boosted trees over the text statistics propose rules: every path from a root is a conjunction of comparisons. A
logistic regression with a lasso penalty over the rules' indicators keeps few of them. The score of a row is then the
logistic of a sum of ``when(rule, weight)``, plain column expressions that Spark compiles.

The fit uses a bounded sample of labelled rows (``labelled.MAX_ROWS``) outside the held-out fold, on the driver, from
statistics alone; scoring covers every row. Edge cases: null and empty texts have zero statistics and are scored like
any other, texts of any length by their whole; rows with equal statistics (ties, repeated rows) get equal scores; an empty
table gives an empty table; extra columns are ignored, whatever their names; with no labelled rows every score is 0.5.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditweave.llm.arrowio import bounded_batches, id_text, map_texts
from auditweave.llm.forest import stats_sample
from auditweave.llm.labelled import MAX_ROWS, remainder
from auditweave.llm.shared import unused
from auditweave.llm.textstats import RATIOS, statistics

TREES, DEPTH, CUTS, SHRINK, LEAST, PENALTY, STEPS = 30, 3, 64, 0.3, 10, 0.0004, 1500
FOLDS, HELD, ACCEPT = 4, 2, 0.7

#: A comparison: statistic, whether it must be below the cut, cut.
Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self, names: list[str] = RATIOS) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for f, below, cut in rule:
                holds = holds & ((F.col(names[f]) < cut) if below else (F.col(names[f]) >= cut))
            total = total + F.when(holds, weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * covers(r, x) for r, w in self.rules), np.zeros(len(x))))))


def covers(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, below, cut in rule:
        out &= (x[:, f] < cut) if below else (x[:, f] >= cut)
    return out


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, path: tuple[Condition, ...] = ()) -> list[tuple[tuple[Condition, ...], np.ndarray, float]]:
    """Second-order regression tree; (path, rows as mask indices, value) for each node but the root; leaves have a value other than nan."""

    def node(rows: np.ndarray, depth: int, path: tuple[Condition, ...]) -> list:
        own = [(path, rows, float("nan"))] if path else []
        best, gs, hs = None, g[rows].sum(), h[rows].sum()
        if depth and len(rows) >= 2 * LEAST:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                k = np.searchsorted(c, x[rows, f], "right")
                gl, hl, n = (np.cumsum(np.bincount(k, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(n < LEAST) | (len(rows) - n < LEAST)] = -1
                j = int(gain.argmax())
                if gain[j] > 1e-6 and (best is None or gain[j] > best[0]):
                    best = (gain[j], f, float(c[j]))
        if best is None:
            return [(path, rows, -gs / (hs + 1))]
        _, f, cut = best
        left = x[rows, f] < cut
        return own + node(rows[left], depth - 1, (*path, (f, True, cut))) + node(rows[~left], depth - 1, (*path, (f, False, cut)))

    return node(np.arange(len(x)), depth, path)


def fit(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    if not len(y):
        return RuleEnsemble(0.0, ())
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = math.log(share / (1 - share))
    if y.min() == y.max():
        return RuleEnsemble(base, ())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:])) for f in range(x.shape[1])]
    raw, rules = np.full(len(y), base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        for path, rows, value in grow(x, p - y, p * (1 - p), cuts, DEPTH):
            rules.setdefault(tuple(sorted(path)), None)
            if value == value:
                raw[rows] += SHRINK * value
    rules = [r for r in rules if r and LEAST <= covers(r, x).sum() <= len(y) - LEAST]
    z = np.column_stack([covers(r, x) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    spread = np.maximum(z.std(0), 1e-9)
    packed, at, count = np.unique(np.packbits(z.astype(bool), axis=1), axis=0, return_inverse=True, return_counts=True)  # equal rows once
    share = np.bincount(at.ravel(), y) / count
    z = np.unpackbits(packed, axis=1, count=len(rules)).astype(float)
    a, part = np.column_stack([z / spread, np.ones(len(z))]), count / len(y)
    step = 4 / max(float(np.linalg.eigvalsh(a.T @ (a * part[:, None]))[-1]), 1e-9)
    w = ahead = np.append(np.zeros(len(rules)), base)
    t = 1.0
    for _ in range(STEPS):  # accelerated proximal gradient; the bias carries no penalty
        v = ahead - step * (a.T @ ((1 / (1 + np.exp(-(a @ ahead))) - share) * part))
        v[:-1] = np.sign(v[:-1]) * np.maximum(np.abs(v[:-1]) - step * PENALTY, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = v + (before - 1) / t * (v - w), v
    return RuleEnsemble(float(w[-1]), tuple((r, float(c / s)) for r, c, s in zip(rules, w[:-1], spread, strict=True) if c))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make():
        def work(texts):
            got = [statistics(t)[1] for t in texts]
            return [[g[k] for g in got] for k in range(len(RATIOS))]

        return work

    return map_texts(id_text(docs, id_col, text_col), make, ", ".join(f"{r} double" for r in RATIOS), RATIOS, [pa.float64()] * len(RATIOS))


def quality_scores(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. train_docs: where the labelled texts are, by default docs."""
    model = fit(*stats_sample(docs if train_docs is None else train_docs, labels, "quality", FOLDS, HELD, max_rows))
    return text_statistics(docs, id_col, text_col).select(
        "doc_id", (F.coalesce(remainder(F.col("doc_id"), FOLDS), F.lit(0)) == HELD).alias("held_out"), model.column().alias("score")
    ).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns as they are, whatever their names; one pass without a shuffle.

    Null and empty texts are judged by their zero statistics; repeated rows alike; an empty table gives an empty table."""
    model = fit(*stats_sample(docs, labels, "quality", FOLDS, HELD, max_rows))
    names = unused(docs, *(f"stat_{r}" for r in RATIOS))
    place = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            got = [statistics(t or "")[1] for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([g[k] for g in got], pa.float64()) for k in range(len(RATIOS)))], [*b.schema.names, *names])

    schema = docs.schema
    for n in names:
        schema = T.StructType([*schema.fields, T.StructField(n, T.DoubleType())])
    return bounded_batches(docs).mapInArrow(run, schema).filter(model.column(names) >= ACCEPT).select(*docs.columns)
