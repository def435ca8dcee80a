"""Hard-negative mining by partial inner products after an orthogonal rotation.

Vectors have integer components. The second moments of all rows, summed by Spark, give a rotation to principal components:
inner products stay as they are while most of a vector's length moves into the leading components. For an anchor and a row,
the sum over the leading components differs from the whole product by no more than the product of the two remainders' norms
(Cauchy-Schwarz) plus a slack for rounding, so a row leaves as soon as its upper bound falls below what enough other rows
are sure to reach, or its bounds leave the band that is asked for. The few that stay after the last component are verified
with integer products; only those decide. The rotation affects speed alone.

Anchors and rows are dealt into blocks by a hash, and each task compares one block of anchors with one block of rows, so its
memory is bounded whatever the tables' sizes. A task sends the best few rows of each anchor; a window merges them. The first
pass finds every anchor's positives, the second every positive's negatives. Rows of a block with one label and one vector are
compared once: no more than the first ids among them can be part of a result.

Edge cases: a row with a null id, label or vector, or any null or non-finite component, takes no part; nor does one whose
product with itself does not fit a long (below 2^62). Shorter vectors count as filled up with zeros; an empty one has the
product 0 with every row. Identical rows count once; different rows of one id are rows of their own, told apart by a 64-bit hash.
Ties go to the smaller id. Anchors without positives, or positives without negatives in the band, give no rows. An empty
table gives an empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.arrowio import bounded_batches
from auditweave.llm.shared import cut

#: Rows and anchors of a block.
ROWS, ANCHORS = 4096, 512
#: So few candidates are verified at once instead of being narrowed further.
FEW = 32
POSITIVES, NEGATIVES = 5, 3
#: Band of a negative's score in hundredths of its positive's.
LOW, HIGH = 50, 95
LARGEST = float(1 << 62)
FOUND = "anchor_id long, akey long, place int, id long, score long"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where a component is null or not finite, or the row's square sum is too large."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 1e300 / scale), F.lit(False)))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fits = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x * x) < LARGEST
    return F.when(finite & fits, F.transform(scaled, lambda x: x.cast("int")))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of integers, filled up with zeros to dim."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim)[None, :] < lengths[:, None]] = flat
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal matrix to principal components, leading first, from the second moments of all rows (dim * dim numbers reach the driver)."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            q = matrix(batch.column(0), dim).astype(np.float64)
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["k", "v"])

    found = bounded_batches(rows.select("q")).mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(dim * dim)
    total[found.column("k").to_numpy()] = found.column("v").to_numpy()
    return np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1].copy()


class Block:
    """Rows by label, then id; equal rows of a label beyond the first ``most`` are left out, since no result can hold them."""

    def __init__(self, table: pa.Table, rotate: np.ndarray, cuts: list[int], most: int | None):
        dim = rotate.shape[0]
        q = matrix(table.column("q"), dim)
        ids, labels, keys = (table.column(c).to_numpy() for c in ("id", "label", "rkey"))
        order = np.lexsort((ids, labels))
        if most and len(order):
            packed = np.ascontiguousarray(np.concatenate([labels[order][:, None], q[order]], 1))
            same = np.unique(packed.view([("", np.int64)] * (dim + 1)).ravel(), return_inverse=True)[1]
            grouped = np.argsort(same, kind="stable")
            s = same[grouped]
            first = np.searchsorted(s, s)
            order = order[np.sort(grouped[np.arange(len(s)) - first < most])]
        self.q, self.ids, self.labels, self.keys = q[order], ids[order], labels[order], keys[order]
        self.y = self.q.astype(np.float64) @ rotate
        squares = self.y**2
        self.norms = np.sqrt(squares.sum(1))
        self.tails = np.stack([np.sqrt(squares[:, c:].sum(1)) for c in cuts], 1)


def stages(dim: int) -> list[int]:
    return sorted({max(1, math.ceil(dim / k)) for k in (8, 4, 2, 1)})


class Search:
    """One block of anchors against one block of rows."""

    def __init__(self, anchors: Block, rows: Block, cuts: list[int]):
        self.a, self.r, self.cuts = anchors, rows, cuts
        self.slack = 256 * (cuts[-1] + 8) * np.finfo(np.float64).eps

    def leading(self, least: np.ndarray, which: slice, rows: slice) -> tuple[int, np.ndarray]:
        """Partial products of some anchors with some rows, taken further together while over an eighth of the pairs may reach ``least``; the stage it came to."""
        ya, yr = self.a.y[which], self.r.y[rows]
        s = ya[:, : self.cuts[0]] @ yr[:, : self.cuts[0]].T
        for c in range(1, len(self.cuts)):
            room = np.outer(self.a.tails[which, c - 1], self.r.tails[rows, c - 1])
            if np.count_nonzero(s + room >= least[:, None]) * 8 < s.size:
                return c - 1, s
            s += ya[:, self.cuts[c - 1] : self.cuts[c]] @ yr[:, self.cuts[c - 1] : self.cuts[c]].T
        return len(self.cuts) - 1, s

    def narrowed(self, i: int, cand: np.ndarray, s: np.ndarray, c: int, k: int, low: int | None = None, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best candidates of anchor i by exact score within [low, high], ties by id, with their scores. s: partial products at stage c."""
        a, r = self.a, self.r
        while True:
            room = a.tails[i, c] * r.tails[cand, c] + self.slack * a.norms[i] * r.norms[cand]
            worst, best = s - room, s + room
            on = np.ones(len(cand), bool) if low is None else (best >= low) & (worst <= high)
            sure = worst if low is None else worst[(worst >= low) & (best <= high)]
            if len(sure) > k:
                on &= best >= np.partition(sure, len(sure) - k)[len(sure) - k]
            cand, s = cand[on], s[on]
            if len(cand) <= FEW or c + 1 == len(self.cuts):
                break
            s = s + r.y[cand, self.cuts[c] : self.cuts[c + 1]] @ a.y[i, self.cuts[c] : self.cuts[c + 1]]
            c += 1
        exact = (r.q[cand] * a.q[i]).sum(1)
        if low is not None:
            inside = (exact >= low) & (exact <= high)
            cand, exact = cand[inside], exact[inside]
        order = np.lexsort((r.ids[cand], -exact))[:k]
        return cand[order], exact[order]

    def positives(self, k: int):
        """(anchor, rows, scores) of the k best other rows of each anchor's label."""
        a, r = self.a, self.r
        for label in np.unique(a.labels).tolist():
            at = slice(*(int(np.searchsorted(a.labels, label, side)) for side in ("left", "right")))
            rows = slice(*(int(np.searchsorted(r.labels, label, side)) for side in ("left", "right")))
            if rows.start == rows.stop:
                continue
            first = a.y[at, : self.cuts[0]] @ r.y[rows, : self.cuts[0]].T - np.outer(a.tails[at, 0], r.tails[rows, 0])
            n = first.shape[1]
            least = np.partition(first, n - k - 1, 1)[:, n - k - 1] if n > k + 1 else np.full(len(first), -np.inf)  # one of them may be the anchor itself
            least -= self.slack * a.norms[at] * r.norms[rows].max()
            c, s = self.leading(least, at, rows)
            every = np.arange(rows.start, rows.stop)
            for j, i in enumerate(range(at.start, at.stop)):
                other = (r.ids[every] != a.ids[i]) | (r.keys[every] != a.keys[i])
                yield i, *self.narrowed(i, every[other], s[j][other], c, k)

    def negatives(self, bands: list[list[tuple[int, int, int]]], k: int):
        """(anchor, place of the positive, rows, scores) of the k best rows of other labels in each positive's band. bands: (place, low, high) by anchor."""
        a, r = self.a, self.r
        least = np.array([min((lo for _, lo, hi in b if lo <= hi), default=math.inf) for b in bands], np.float64)
        c, s = self.leading(least, slice(None), slice(None))
        for i, asked in enumerate(bands):
            bound = s[i] + a.tails[i, c] * r.tails[:, c] + self.slack * a.norms[i] * r.norms
            cand = np.flatnonzero((bound >= least[i]) & (r.labels != a.labels[i]))
            for place, lo, hi in asked:
                if lo <= hi and len(cand):
                    yield i, place, *self.narrowed(i, cand, s[i, cand], c, k, lo, hi)


def band(positive: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores n with low * positive <= 100 * n <= high * positive, as first and last."""
    return -((-low * positive) // 100), (high * positive) // 100


def _cells(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int):
    """Every block of anchors beside every block of rows, as one cogroup for each pair of blocks."""
    a, b = math.ceil(n_anchors / ANCHORS), math.ceil(n_rows / ROWS)
    block = lambda n: F.pmod("rkey", F.lit(n)).cast("int")
    own = lambda df: [F.col(c).alias(c) for c in df.columns]  # noqa: E731  both sides come from one table: without columns of its own, a side is mixed up with the other
    left = anchors.select(*own(anchors), block(a).alias("ab"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("rb"))
    right = rows.select(*own(rows), F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("ab"), block(b).alias("rb"))
    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb"))


NAMES = ["anchor_id", "akey", "place", "id", "score"]
NOTHING = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())], NAMES)


def _found(parts: list[tuple], anchors: Block, rows: Block) -> pa.Table:
    """parts: (anchor, place, rows, scores)."""
    n = [len(p[2]) for p in parts]
    i = np.repeat(np.array([p[0] for p in parts], np.int64), n)
    cand = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
    score = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0, np.int64)
    place = np.repeat(np.array([p[1] for p in parts], np.int32), n)
    return pa.table([pa.array(anchors.ids[i]), pa.array(anchors.keys[i]), pa.array(place, pa.int32()), pa.array(rows.ids[cand]), pa.array(score)], NAMES)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """rows: id long, label long, q array<int>. anchor: which rows are anchors.

    Result: anchor_id, positive_id, rank, negative_id, positive_score, negative_score; low * positive <= 100 * negative <= high * positive."""
    clean = rows.filter("id is not null and label is not null and q is not null").select("id", "label", "q", F.coalesce(anchor, F.lit(False)).alias("anchor")).distinct()
    clean = cut(clean.withColumn("rkey", F.xxhash64("id", "label", "q")))
    n_rows, n_anchors, dim = clean.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("q"))).first()
    dim = max(dim or 0, 1)
    rotate, cuts = rotation(clean, dim), stages(dim)
    anchors, rows = clean.filter("anchor").drop("anchor"), clean.drop("anchor")
    n_rows, n_anchors = max(n_rows, 1), max(n_anchors, 1)

    def search_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return NOTHING
        a, r = Block(left, rotate, cuts, None), Block(right, rotate, cuts, positives + 1)
        return _found([(i, 0, cand, score) for i, cand, score in Search(a, r, cuts).positives(positives)], a, r)

    by_score = [F.col("score").desc(), F.col("id")]
    local = _cells(anchors, rows, n_anchors, n_rows).applyInArrow(search_positives, FOUND)
    w = Window.partitionBy("anchor_id", "akey").orderBy(*by_score)
    chosen = cut(local.select("anchor_id", "akey", "id", "score", F.row_number().over(w).alias("place")).filter(F.col("place") <= positives))
    listed = chosen.groupBy("anchor_id", "akey").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("wanted"))  # of ``positives`` at most
    asking = anchors.join(listed, (F.col("id") == F.col("anchor_id")) & (F.col("rkey") == F.col("akey"))).select("id", "label", "q", "rkey", "wanted")

    def search_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return NOTHING
        a, r = Block(left, rotate, cuts, None), Block(right, rotate, cuts, negatives)
        wanted = {(i, k): w for i, k, w in zip(left.column("id").to_pylist(), left.column("rkey").to_pylist(), left.column("wanted").to_pylist(), strict=True)}
        bands = [[(x["place"], *band(x["score"], low, high)) for x in wanted[i, k]] for i, k in zip(a.ids.tolist(), a.keys.tolist(), strict=True)]
        return _found(list(Search(a, r, cuts).negatives(bands, negatives)), a, r)

    local = _cells(asking, rows, n_anchors, n_rows).applyInArrow(search_negatives, FOUND)
    w = Window.partitionBy("anchor_id", "akey", "place").orderBy(*by_score)
    hard = local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= negatives)
    pairs = chosen.select("anchor_id", "akey", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.select("anchor_id", "akey", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor_id", "akey", "place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(vectors: DataFrame) -> DataFrame:
    """Hard negatives of a table vec_id, embedding, label: labels of every seventh id shifted by one, components scaled by 256, every fiftieth id an anchor."""
    label = F.col("label").cast("long")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), quantised(F.col("embedding")).alias("q"))
    return hard_negatives(rows, F.col("id") % 50 == 0)
