"""Corpus-wide lookups of hashes without a row for each hash.

Documents are dealt into blocks by their id. A block sends its distinct hashes, packed into one binary value for each
bucket of the hash space, so the largest multiplicity of any hash in a bucket is the number of blocks, however often one
passage occurs (aggregation before the shuffle). A bucket compares the values of all blocks and answers each block with one
small array in the order in which the hashes were sent; the block recomputes that order from its documents. Blocks and
buckets follow spark.sql.shuffle.partitions, so the session's setting for the input's size governs the memory of a task.

Words are hashed with a polynomial over random byte values (64 bit, mixed); word sequences by a second one over the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.llm.arrowio import id_text

#: More buckets than this would make the packed values small: at 100 TB in a million partitions they are some 400 bytes and
#: a bucket some 400 MB.
MOST_BUCKETS = 200_000
CHUNK = 1 << 20
RNG = np.random.default_rng(20240501)
BYTE = RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = RNG.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def layout(spark: SparkSession) -> tuple[int, int]:
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 2 * n, min(n, MOST_BUCKETS)


def blocked(docs: DataFrame, n_blocks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = id_text(docs, id_col, text_col)
    return rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int").alias("block"), "doc_id", "text")


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text. Memory follows CHUNK and the longest text."""
    hashes, counts, i = [], np.zeros(len(texts), np.int64), 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j]) + 1
            j += 1
        data = np.frombuffer(b"\n".join(texts[i:j]) + b"\n", np.uint8)
        blank = SPACES[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        if len(starts):
            lengths = ends - starts
            inside = np.flatnonzero(~blank)
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            place = np.arange(len(inside)) - np.repeat(first, lengths)
            values = BYTE[LOWER[data[inside]] if lower else data[inside]] * powers(int(lengths.max()))[place]
            hashes.append(mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)))
            at = np.cumsum([0, *(len(t) + 1 for t in texts[i:j])])
            counts[i:j] = np.diff(np.searchsorted(starts, at))
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def sequence_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` words from each place on, over text borders too (the caller leaves those out)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += words[k : k + n] * STEP[k]
    return mix(out)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of a sorted array."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def packed(block: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Rows (bucket, block, one binary for each column) of arrays sorted by bucket."""
    at = runs(bucket)
    ends = np.append(at[1:], len(bucket)) if len(at) else at
    cols = [pa.array([c[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()) for c in columns]
    names = ["values", "extra"][: len(cols)]
    return pa.table([pa.array(bucket[at], pa.int32()), pa.array(np.full(len(at), block), pa.int32()), *cols], ["bucket", "block", *names])


def answers(table: pa.Table, asked: str, stage: int, to_bytes) -> pa.Table:
    """One answer for each block of a bucket: to_bytes(part of the result that belongs to the block)."""
    return pa.table([table.column("block").cast(pa.int32()), pa.array(np.full(table.num_rows, stage), pa.int32()), table.column("bucket").cast(pa.int32()), pa.array(to_bytes, pa.binary())], ["block", "stage", "bucket", asked])


def spread(table: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a bucket one behind the other, and where each block's begin."""
    parts = [np.frombuffer(v, dtype) for v in table.column("values").to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.cumsum([0, *map(len, parts)])


def in_order(table: pa.Table, stage: int) -> list[bytes]:
    """Answers of a stage by bucket."""
    rows = [(b, v) for s, b, v in zip(table.column("stage").to_pylist(), table.column("bucket").to_pylist(), table.column("answer").to_pylist(), strict=True) if s == stage]
    return [v for _, v in sorted(rows)]


def pieces(n: int, size: int) -> Iterator[slice]:
    for i in range(0, n, size):
        yield slice(i, min(n, i + size))
