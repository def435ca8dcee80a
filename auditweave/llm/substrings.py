"""Removal of passages that repeat across documents, by difference-cover anchors.

A window of 13 words is removed where its words also start in a document with a smaller id. Anchors are hashes of 7 words,
taken only at positions that are 0, 1 or 3 modulo 7. These residues are a difference cover: for any two positions i and j
some shift below 7 brings both onto anchor positions, and 6 + 7 words fit in a window, so equal windows always share an
aligned anchor. First all anchors (three sevenths of the positions, four bytes each) are looked up for other documents;
then each match is extended: the windows around shared anchors are looked up whole by a 64-bit hash, with the smallest
doc_id that each block has for it. Both lookups go through ``blocks``: no pairs, no group larger than the number of blocks.

Edge cases: null and empty texts have no words; a text of any length is one document of one block and handled whole; of
documents with the same window the smallest doc_id keeps it, so rows with equal doc_id (ties, repeated rows) don't remove
from each other; a row without doc_id keeps all words and removes none; an empty table gives an empty table; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditweave.llm import blocks as B
from auditweave.llm.arrowio import bounded_batches

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
SENT = "bucket int, block int, values binary, extra binary"
ANSWER = "block int, stage int, bucket int, answer binary"


class Block:
    """The documents of one block in order of id and text, their words, and what each lookup asks."""

    def __init__(self, table: pa.Table, n_buckets: int) -> None:
        self.n_buckets = n_buckets
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
        self.ids, self.texts = [ids[k] for k in order], [texts[k].encode("utf-8", "surrogatepass") for k in order]
        self.words, self.counts = B.word_hashes(self.texts)
        has = np.array([i is not None for i in self.ids], bool)
        self.owner = np.repeat(np.array([i if i is not None else 0 for i in self.ids], np.int64), self.counts)
        self.row = np.repeat(np.arange(len(self.ids)), self.counts)
        self.named = np.repeat(has, self.counts)
        ends = np.cumsum(self.counts)
        self.place = np.arange(len(self.words)) - np.repeat(ends - self.counts, self.counts)
        self.left = np.repeat(ends, self.counts) - np.arange(len(self.words))  # words from here to the end of the text

    def asked(self, h: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct (bucket, hash), and for each of the hashes its place among them."""
        bucket = B.bucket_of(h, self.n_buckets)
        value = h & np.uint64(0xFFFFFFFF) if narrow else h
        order = np.lexsort((value, bucket))
        same = (bucket[order][1:] == bucket[order][:-1]) & (value[order][1:] == value[order][:-1])
        first = np.flatnonzero(np.concatenate([[True], ~same])) if len(h) else np.zeros(0, np.int64)
        at = np.empty(len(h), np.int64)
        at[order] = np.cumsum(np.concatenate([[0], ~same])) if len(h) else 0
        return bucket[order][first], value[order][first], at

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes."""
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= ANCHOR) & self.named)
        return at, B.sequence_hashes(self.words, ANCHOR)[at]

    def several(self, at: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Which of n distinct values have more than one owner in this block."""
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, at, owner)
        np.maximum.at(high, at, owner)
        return low < high

    def ask_anchors(self, block: int) -> pa.Table:
        bucket, value, _ = self.asked(self.anchors()[1], True)
        return B.packed(block, bucket, value.astype(np.uint32), np.zeros(len(bucket), np.uint8)[:0])

    def windows(self, shared: list[bytes]) -> np.ndarray:
        """Starts of the windows with a shared anchor inside."""
        pos, h = self.anchors()
        bucket, _, at = self.asked(h, True)
        sizes = np.diff(np.append(B.runs(bucket), len(bucket)))
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(shared, sizes, strict=True)]
        hit = (np.concatenate(bits) > 0 if bits else np.zeros(0, bool)) | self.several(at, self.owner[pos], len(bucket))
        near = np.zeros(len(self.words) + PERIOD, bool)
        for k in range(PERIOD):
            near[np.maximum(pos[hit[at]] - k, 0)] = True
        return np.flatnonzero(near[: len(self.words)] & (self.left >= WINDOW) & self.named)

    def lowest(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """bucket, hash, smallest id in the block, of the distinct windows; and the place of each window."""
        bucket, value, at = self.asked(B.sequence_hashes(self.words, WINDOW)[start], False)
        low = np.full(len(bucket), np.iinfo(np.int64).max)
        np.minimum.at(low, at, self.owner[start])
        return bucket, value, low, at

    def ask_windows(self, block: int, shared: list[bytes]) -> pa.Table:
        bucket, value, low, _ = self.lowest(self.windows(shared))
        return B.packed(block, bucket, value, low)

    def removed(self, shared: list[bytes], smaller: list[bytes]) -> np.ndarray:
        start = self.windows(shared)
        bucket, _, low, at = self.lowest(start)
        sizes = np.diff(np.append(B.runs(bucket), len(bucket)))
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(smaller, sizes, strict=True)]
        elsewhere = np.concatenate(bits) > 0 if bits else np.zeros(0, bool)
        gone = start[elsewhere[at] | (low[at] < self.owner[start])]
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WINDOW, -1)
        return np.cumsum(edge)[:-1] > 0


def anchor_bucket(table: pa.Table) -> pa.Table:
    """For each anchor of each block: whether another block has it."""
    values, begin = B.spread(table, np.uint32)
    order = np.argsort(values, kind="stable")
    at = B.runs(values[order])
    shared = np.empty(len(values), bool)
    shared[order] = np.repeat(np.diff(np.append(at, len(values))) > 1, np.diff(np.append(at, len(values))))
    return B.answers(table, "answer", 1, [np.packbits(shared[a:b]).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)])


def window_bucket(table: pa.Table) -> pa.Table:
    """For each window of each block: whether another block has it with a smaller id than the block's own smallest."""
    values, begin = B.spread(table, np.uint64)
    low = np.concatenate([np.frombuffer(v, np.int64) for v in table.column("extra").to_pylist()]) if table.num_rows else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    at = B.runs(values[order])
    least = np.empty(len(values), np.int64)
    if len(values):
        least[order] = np.repeat(np.minimum.reduceat(low[order], at), np.diff(np.append(at, len(values))))
    smaller = least < low
    return B.answers(table, "answer", 2, [np.packbits(smaller[a:b]).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)])


def removed_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256; with keep_text also ``kept`` (the kept words joined by one space)."""
    n_blocks, n_buckets = B.layout(docs.sparkSession)
    rows = B.blocked(docs, n_blocks, id_col, text_col)
    bounded_batches(docs)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    names = [x.split()[0] for x in schema.split(", ")]

    def ask_anchors(key, table):
        return Block(table, n_buckets).ask_anchors(key[0].as_py())

    def ask_windows(key, table, reply):
        return Block(table, n_buckets).ask_windows(key[0].as_py(), B.in_order(reply, 1))

    def finish(key, table, reply):
        block = Block(table, n_buckets)
        gone, out, at = block.removed(B.in_order(reply, 1), B.in_order(reply, 2)), [], 0
        for i, text, n in zip(block.ids, block.texts, block.counts.tolist(), strict=True):
            words, mask = text.split(), gone[at : at + n]
            kept = b" ".join(w for w, g in zip(words, mask.tolist(), strict=True) if not g) if mask.any() else b" ".join(words)
            out.append((i, n, int(mask.sum()), hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "surrogatepass")] * keep_text))
            at += n
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, pa.string() if n.startswith("kept") else pa.int64()) for c, n in zip(columns, names, strict=True)], names)

    by_block = rows.groupBy("block")
    shared = by_block.applyInArrow(ask_anchors, SENT).groupBy("bucket").applyInArrow(anchor_bucket, ANSWER)
    smaller = by_block.cogroup(shared.groupBy("block")).applyInArrow(ask_windows, SENT).groupBy("bucket").applyInArrow(window_bucket, ANSWER)
    return by_block.cogroup(shared.union(smaller).groupBy("block")).applyInArrow(finish, schema)
