"""Jaccard join of shingle sets by signature trees, and the components that its links make.

1. Root test. A corpus-wide lookup (``blocks``) tells for every shingle how many blocks have it. A document can only link if
   80 % of its shingles occur in some other document; the others leave here, which are nearly all in ordinary corpora.
   Only shingles that another document has too can be common to two sets: these are kept, with the size of the whole set.
2. Equal sets become one representative (smallest doc_id).
3. Groups. Shingles are ordered rarest first; two linking sets share one of their first n - ceil(0.8 n) + 1. Each
   representative enters the groups of these. In a group, every member is first tested against one pivot of its size, the
   member with the most widespread shingles, which joins large groups of near copies in linear time.
4. Members whose common shingles cannot reach 80 % with the smallest member of a group leave it. Groups that still hold
   several components and have the same smallest member make one family.
5. Trees. A family is searched by a dual traversal of signature trees: members sorted by size under nodes with the OR of
   their token bitmaps and their size range. A pair of nodes is left out when sizes are too far apart, when all below is
   one component already, or when the largest possible overlap (common bits plus the most tokens that share a bit in a
   member) is below what 80 % needs. A pair of members that gets through is verified on the whole sets then and there, and
   its components are joined, so a search gives fewer links than it has members. In a family beyond ``CAP`` members only
   those outside its largest component are copied: each part of the others meets each part of the largest one.

Nothing is dropped: the groups cover all pairs that can link, bounds only leave out pairs that can't, and components that
are joined already need no further links. Shingles are 64-bit hashes: among 10^13 different shingles some 2.7 million pairs
share one, so a given link can only be wrong if several of the few shingles that decide it do. Edge cases: texts with fewer
than five words have one shingle; null and empty texts have none and link with nothing; rows of one doc_id count as one
document; a row without doc_id has no component; ties of rarity go by hash and equal sets by doc_id; a text of any length
is one set and is handled whole; an empty table gives an empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm import blocks as B
from auditweave.llm.arrowio import bounded_batches
from auditweave.llm.graph import components
from auditweave.llm.shared import cut, discard, unused

WIDTH, PERCENT = 5, 80
#: Members of a family that one search sees, twice as many for a pair of parts; and pairs that one copy of a pivot's set serves.
CAP, FAN = 1024, 8
#: Bits of a bitmap at most; beyond, tokens share bits, which the bounds count.
WIDEST = 1 << 16
#: Ids that are broadcast at most (some MB); beyond, the same join is by shuffle.
FEW = 200_000
SENT = "bucket int, block int, values binary, extra binary"
ANSWER = "block int, stage int, bucket int, answer binary"


def may_link(overlap: int, x: int, y: int, percent: int = PERCENT) -> bool:
    """Whether an intersection of that size is percent of the union of sets of x and y or more."""
    return overlap * (100 + percent) >= percent * (x + y)


# --- 1: shingles and the root test


class ShingleBlock:
    def __init__(self, table: pa.Table, n_buckets: int, width: int) -> None:
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
        self.ids = [ids[k] for k in order]
        words, counts = B.word_hashes([texts[k].encode("utf-8", "surrogatepass") for k in order], lower=True)
        ends = np.cumsum(counts)
        row = np.repeat(np.arange(len(ids)), counts)
        whole = np.flatnonzero(np.repeat(ends, counts) - np.arange(len(words)) >= width)
        h, at = [B.sequence_hashes(words, width)[whole]], [row[whole]]
        for n in range(1, width):
            few = np.flatnonzero(counts == n)
            if len(few):
                at.append(few)
                h.append(B.mix(B.sequence_hashes(words, n)[(ends - counts)[few]] + np.uint64(n)))
        h, at = np.concatenate(h), np.concatenate(at)
        order = np.lexsort((h, at))
        h, at = h[order], at[order]
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1])]) if len(h) else np.zeros(0, bool)
        self.h, self.row = h[first], at[first]
        self.sizes = np.bincount(self.row, minlength=len(ids))
        bucket, value = B.bucket_of(self.h, n_buckets), self.h & np.uint64(0xFFFFFFFF)
        order = np.lexsort((value, bucket))
        same = (bucket[order][1:] == bucket[order][:-1]) & (value[order][1:] == value[order][:-1])
        first = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
        self.bucket, self.value = bucket[order][first], value[order][first].astype(np.uint32)
        self.at = np.empty(len(order), np.int64)
        self.at[order] = np.cumsum(first) - 1
        self.often = np.bincount(self.at, minlength=len(self.bucket)) > 1  # in several documents of this block

    def ask(self, block: int) -> pa.Table:
        return B.packed(block, self.bucket, self.value, np.zeros(0, np.uint8))

    def rows(self, answer: list[bytes], percent: int) -> pa.Table:
        """doc_id, n; for those that may link also the key of the set, its shingles that others have, their rarity and its mean."""
        rarity = np.frombuffer(b"".join(answer), np.uint8)
        rarity = np.maximum(rarity, self.often)[self.at] if len(self.at) else np.zeros(0, np.uint8)
        shared = np.bincount(self.row, rarity > 0, len(self.ids)).astype(np.int64)
        begin, stay = np.cumsum(np.concatenate([[0], self.sizes])), (self.sizes > 0) & (100 * shared >= percent * self.sizes)
        sets, marks, keys, weights = [], [], [], []
        for k, keep in enumerate(stay.tolist()):
            h, r = (x[begin[k] : begin[k + 1]] for x in (self.h, rarity))
            sets.append(h[r > 0].tobytes() if keep else None)
            marks.append(r[r > 0].tobytes() if keep else None)
            keys.append(hashlib.md5(h.tobytes()).digest() if keep else None)
            weights.append(1000 * int(r.sum()) // len(h) if keep else None)
        columns = [pa.array(self.ids, pa.int64()), pa.array(self.sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (keys, sets, marks)), pa.array(weights, pa.int64())]
        return pa.table(columns, ["doc_id", "n", "key", "members", "rarity", "weight"])


def counting_bucket(table: pa.Table) -> pa.Table:
    """For each value of each block: 16 times the logarithm of the number of blocks that have it, 255 at most."""
    values, begin = B.spread(table, np.uint32)
    order = np.argsort(values, kind="stable")
    at = B.runs(values[order])
    many = np.diff(np.append(at, len(values)))
    out = np.empty(len(values), np.uint8)
    out[order] = np.repeat(np.minimum(255, np.round(16 * np.log2(np.maximum(many, 1)))).astype(np.uint8), many)
    return B.answers(table, "answer", 1, [out[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)])


def candidates(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    n_blocks, n_buckets = B.layout(docs.sparkSession)
    by_block = B.blocked(bounded_batches(docs), n_blocks, id_col, text_col).groupBy("block")

    def ask(key, table):
        return ShingleBlock(table, n_buckets, width).ask(key[0].as_py())

    def tell(key, table, reply):
        return ShingleBlock(table, n_buckets, width).rows(B.in_order(reply, 1), percent)

    counted = by_block.applyInArrow(ask, SENT).groupBy("bucket").applyInArrow(counting_bucket, ANSWER)
    return by_block.cogroup(counted.groupBy("block")).applyInArrow(tell, "doc_id long, n long, key binary, members binary, rarity binary, weight long")


# --- 3: groups and pivots


def group_rows(reps: DataFrame, percent: int) -> DataFrame:
    """(t, band, rep, n, shared, weight): the rarest shingles of each representative that another document has too, and its size band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(6)]
            for rep, n, weight, members, rarity in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, r = np.frombuffer(members, np.uint64), np.frombuffer(rarity, np.uint8)
                first = n + (-percent * n) // 100 + 1 - (n - len(h))  # shingles that no other document has come first and make no group
                t = h[np.lexsort((h, r))[: max(first, 0)]].view(np.int64)
                band = int(np.log(n) / np.log(100 / percent))
                for c, v in zip(out, (t, band, rep, n, len(h), weight), strict=True):
                    c.append(v if v is t else np.full(len(t), v, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["t", "band", "rep", "n", "shared", "weight"])

    return reps.select("rep", "n", "weight", "members", "rarity").mapInArrow(run, "t long, band long, rep long, n long, shared long, weight long")


def pivot_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): each representative with the pivot that most of its groups name: the member of its size band with the most widespread shingles."""
    pivots = rows.groupBy("t", "band").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("p"), F.count("*").alias("many")).filter("many > 1").select("t", "band", (-F.col("p.rep")).alias("pivot"))
    named = rows.select("t", "band", "rep").join(pivots, ["t", "band"]).filter("pivot <> rep").groupBy("rep", "pivot").agg(F.count("*").alias("times"))
    return named.groupBy("rep").agg(F.max(F.struct("times", (-F.col("pivot")).alias("pivot"))).alias("best")).select(F.col("rep").alias("a"), (-F.col("best.pivot")).alias("b"))


def verified(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. One b may stand in any number of pairs: its set goes to one task for each ``CAP`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y, nx, ny in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(may_link(len(np.intersect1d(x, y, assume_unique=True)), nx, ny, percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = cut(pairs)
    asked = pairs.groupBy("b").agg(F.ceil(F.count("*") / CAP).cast("int").alias("parts"))
    pairs = pairs.join(asked, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    sets = reps.select("rep", "members", "n")
    if ends.limit(FEW + 1).count() <= FEW:  # few sets are asked for: only these are shuffled
        sets = sets.join(F.broadcast(ends), "rep", "left_semi")
    x, y = (sets.select(F.col("rep").alias(k), F.col("members").alias(f"m{k}"), F.col("n").alias(f"n{k}")) for k in ("a", "b"))
    y = y.join(asked, "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = pairs.join(x, "a").join(y, ["b", "part"]).filter((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
    return both.select("a", "b", "ma", "mb", "na", "nb").mapInArrow(run, "a long, b long")


# --- 4: families


def families(rows: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(family, rep, comp): members of the groups that may still hold a link between two components."""
    owner = label.select(F.col("node").alias("rep"), "comp")
    placed = rows.select("t", "rep", "n", "shared").join(owner, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    several = lambda df, *more: df.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *more).filter("lo < hi").drop("lo", "hi")
    can = (F.col("least") < F.col("shared")) | (F.col("shared") * (100 + percent) >= percent * (F.col("n") + F.col("least")))
    able = placed.join(several(placed, F.min("n").alias("least")), "t").filter(can)
    return able.join(several(able, F.min("rep").alias("family")), "t").select("family", "rep", "comp").distinct()


def celled(rows: DataFrame) -> DataFrame:
    """(family, kind, i, j, side, rep, comp): what one search sees. kind 0, i = j: pairs inside; otherwise pairs of two sides.

    A family of up to CAP members is one search. In a larger one, parts of the members outside its largest component meet
    each other (kind 0) and the parts of the largest component (kind 1), whose members need not meet."""
    by_comp = rows.groupBy("family", "comp").agg(F.count("*").alias("c"))
    size = by_comp.groupBy("family").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("big"))
    parts = lambda c: F.greatest(F.ceil(c / CAP), F.lit(1)).cast("int")
    size = size.select("family", "all", F.col("big.comp").alias("largest"), parts(F.col("big.c")).alias("inner"), parts(F.col("all") - F.col("big.c")).alias("outer"))
    rows = rows.join(size, "family").withColumn("bulk", F.col("comp") == F.col("largest"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.when(F.col("bulk"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    upto, zero, part = (lambda n: F.sequence(F.lit(0), F.col(n) - 1)), F.lit(0), F.col("part")
    met = F.transform(upto("outer"), lambda q: cell(0, F.least(part, q), F.greatest(part, q), part))
    to_bulk = F.transform(upto("inner"), lambda b: cell(1, b, part, F.lit(1)))
    cells = F.when(F.col("all") <= CAP, F.array(cell(0, zero, zero, zero))).when(F.col("bulk"), F.transform(upto("outer"), lambda r: cell(1, part, r, zero))).otherwise(F.concat(met, to_bulk))
    return rows.select("family", "rep", "comp", F.explode(cells).alias("at")).select("family", "at.*", "rep", "comp")


# --- 5: signature trees


class Node:
    """OR-combined bitmap, size range, the most tokens of a member, the most beyond its bits, and the component if it is only one."""

    __slots__ = ("bits", "comp", "high", "inside", "low", "most", "rep", "slack")

    def __init__(self, bits: int, low: int, high: int, most: int, slack: int, comp: int | None, rep: int | None = None, inside: tuple[Node, ...] = ()) -> None:
        self.bits, self.low, self.high, self.most, self.slack, self.comp, self.rep, self.inside = bits, low, high, most, slack, comp, rep, inside

    @staticmethod
    def over(nodes: list[Node]) -> Node:
        bits = 0
        for x in nodes:
            bits |= x.bits
        comp = nodes[0].comp if len({x.comp for x in nodes}) == 1 else None
        return Node(bits, min(x.low for x in nodes), max(x.high for x in nodes), max(x.most for x in nodes), max(x.slack for x in nodes), comp, None, tuple(nodes))


def most_overlap(x: Node, y: Node) -> int:
    """No set under x shares more members with one under y."""
    return min(x.most, y.most, (x.bits & y.bits).bit_count() + min(x.slack, y.slack))


def tree(members: list[Node]) -> Node:
    nodes = sorted(members, key=lambda m: (m.low, m.comp, m.rep))
    while len(nodes) > 1:
        nodes = [Node.over(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
    return nodes[0]


def dual(x: Node, y: Node, percent: int, joined) -> Iterator[tuple[Node, Node]]:
    """Pairs of members, one under each node (or two under one node), that no bound leaves out; joined(comp, comp) may change between pairs."""
    todo = [(x, y)]
    while todo:
        x, y = todo.pop()
        if x.comp is not None and y.comp is not None and joined(x.comp, y.comp):
            continue
        if x is y:
            if x.rep is None:
                todo += [(x.inside[i], x.inside[j]) for i in range(len(x.inside)) for j in range(i, len(x.inside))]
            continue
        if 100 * x.high < percent * y.low or 100 * y.high < percent * x.low or not may_link(most_overlap(x, y), x.low, y.low, percent):
            continue
        if x.rep is not None and y.rep is not None:
            if x.rep != y.rep:
                yield x, y
        elif y.rep is not None or (x.rep is None and x.high - x.low >= y.high - y.low):
            todo += [(c, y) for c in x.inside]
        else:
            todo += [(x, c) for c in y.inside]


def searched(members: list[tuple[int, int, int, int, bytes]], percent: int, inside: bool) -> list[tuple[int, int]]:
    """members: side, rep, comp, n, shingles. Verified links (larger, smaller rep) that join two components, fewer than there are members."""
    sets = [np.frombuffer(m[4], np.uint64) for m in members]
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1  # tokens that two members have, numbered; the others are in no overlap
    ends = np.cumsum([0, *map(len, sets)])
    own = [number[t[often[t] > 1]] for t in (token[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))]
    width = min(WIDEST, 1 << max(6, int(2 * max(map(len, own)) - 1).bit_length()))
    sides: dict[int, list[Node]] = defaultdict(list)
    tokens = {}
    for (side, rep, comp, n, _), t in zip(members, own, strict=True):
        flags = np.zeros(width, bool)
        flags[t % width] = True
        bits = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        tokens[rep] = t
        sides[side].append(Node(bits, n, n, len(t), len(t) - bits.bit_count(), comp, rep))
    if not inside and len(sides) < 2:
        return []
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    trees, found = [tree(m) for _, m in sorted(sides.items())], []
    for x, y in dual(trees[0], trees[-1], percent, lambda a, b: find(a) == find(b)):
        if may_link(len(np.intersect1d(tokens[x.rep], tokens[y.rep], assume_unique=True)), x.low, y.low, percent):
            root[find(x.comp)] = find(y.comp)
            found.append((max(x.rep, y.rep), min(x.rep, y.rep)))
    return found


def tree_links(rows: DataFrame, reps: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(a, b): verified links between components; each search gives fewer than it has members."""
    slots = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cut(celled(cut(families(rows, label, percent))))
    wanted, sets = cells.select("rep").distinct(), reps.select("rep", "n", "members")
    if wanted.limit(FEW + 1).count() <= FEW:
        sets = sets.join(F.broadcast(wanted), "rep", "left_semi")
    ready = cells.join(sets, "rep").withColumn("slot", F.pmod(F.xxhash64("family", "kind", "i", "j"), F.lit(slots)).cast("int"))

    def search(table: pa.Table) -> pa.Table:
        groups: dict[tuple, list] = defaultdict(list)
        for family, kind, i, j, *row in zip(*(table.column(c).to_pylist() for c in ("family", "kind", "i", "j", "side", "rep", "comp", "n", "members")), strict=True):
            groups[family, kind, i, j].append(tuple(row))
        links = sorted({link for (_, kind, i, j), members in groups.items() for link in searched(sorted(members), percent, kind == 0 and i == j)})
        return pa.table([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return ready.select("slot", "family", "kind", "i", "j", "side", "rep", "comp", "n", "members").groupBy("slot").applyInArrow(search, "a long, b long").distinct()


# --- all of it


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    found = cut(candidates(docs, id_col, text_col, width, percent))
    base = cut(found.select("doc_id", "n", "key"))
    staying = found.filter("key is not null and doc_id is not null")
    reps = cut(staying.groupBy("key").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "members", "rarity", "weight"))))
    discard(found)
    staying = base.filter("key is not null and doc_id is not null")
    rows = cut(group_rows(reps, percent))
    label = components(verified(pivot_pairs(rows), reps, percent))
    links = tree_links(rows, reps, label, percent)
    of = [label.select(F.col("node").alias(k), F.col("comp").alias(f"c{k}")) for k in ("a", "b")]
    lifted = links.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = components(lifted).select(F.col("node").alias("at"), F.col("comp").alias("to"))
    old = label.join(more, F.col("comp") == F.col("at"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
    new = more.join(label, F.col("at") == F.col("node"), "left_anti").select(F.col("at").alias("node"), F.col("to").alias("comp"))
    label = old.union(new)
    of = cut(reps.select("key", "rep").join(label.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("key", F.coalesce("comp", "rep").alias("comp")))
    discard(reps, rows)
    linked = staying.select("doc_id", "n", "key").join(of, "key").select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
    alone = base.filter("key is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component stays (the smallest doc_id; of repeated rows of a doc_id one), all columns as they are.

    Documents without words link with nothing and stay; a row without doc_id stays; an empty table gives an empty table;
    columns of any name pass through."""
    found = cut(near_duplicates(docs, id_col, text_col, width, percent)).filter("doc_id is not null")
    again = found.groupBy("doc_id").agg(F.count("*").alias("many"), F.min("component_id").alias("comp"))
    leaving, place = unused(docs, "leaving", "place")
    gone = again.filter("many > 1 or comp <> doc_id").select(F.col("doc_id").alias(leaving))
    gone = F.broadcast(gone) if gone.limit(5 * FEW + 1).count() <= 5 * FEW else gone
    stay = docs.join(gone, F.col(id_col) == F.col(leaving), "left_anti")
    repeated = again.filter("many > 1 and comp = doc_id").select(F.col("doc_id").alias(leaving))
    if repeated.limit(1).count():
        first = F.row_number().over(Window.partitionBy(leaving).orderBy(F.xxhash64(text_col), text_col))
        stay = stay.union(docs.join(repeated, F.col(id_col) == F.col(leaving)).withColumn(place, first).filter(F.col(place) == 1).select(*docs.columns))
    return stay
