"""Arrow batches of text as flat byte arrays, so that NumPy can work on many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that is worked on at once in a task; one longer document makes a slice of its own.
SLICE_BYTES = 4 << 20
#: Rows that Spark hands to Python at once.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker's memory doesn't depend on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def sent(rows: DataFrame, limit: int = 500_000) -> DataFrame:
    """A written table of a few narrow columns, sent to all tasks while it has at most `limit` rows, else joined by a sort."""
    return F.broadcast(rows) if rows.count() <= limit else rows.hint("merge")


def id_text(docs: DataFrame, *more: str, key: str = "doc_id") -> DataFrame:
    """Only the columns that an operator needs, by exact name; others, clashing names included, are left behind."""
    return docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"), *more)


def sample(rows: DataFrame, n: int, key: str, spare: int = 4) -> DataFrame:
    """The n rows of smallest id hash among those in one of the hash classes that hold about spare * n rows.

    Small tables have one class. Tasks so return a few rows each, not n, whatever their number.
    """
    classes = max(1, rows.count() // (spare * n))
    return rows.where(F.pmod(F.xxhash64(key), F.lit(classes)) == 0).orderBy(F.xxhash64(key, F.lit(1)), key).limit(n)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches by the bytes of a column.

    Pieces are copies that start at zero: Arrow's ascii_lower misreads an array that is a view into another one's data.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch if stop - at == batch.num_rows else batch.take(pa.array(np.arange(at, stop)))
            at = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, off - off[0] if len(off) else np.zeros(1, np.int64)


def runs(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of maximal runs of marked bytes; a run never crosses a document."""
    n = len(is_word)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_R = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _R, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0x94D049BB133111EB)


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    at = within + np.repeat(starts, lengths)
    terms = (raw[at].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i .. i + k - 1 at i, for every i with as many words left."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n, p = len(words) - k + 1, powers(k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * p[j + 1]
    return mix(out)


class Lookup:
    """Values by integer key: open addressing in arrays."""

    def __init__(self, key: np.ndarray, *values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(key), 1) * 2.5))))
        self.keys, self.at = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        self.values = values
        slot, left, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] < 0
            go = left[free]
            self.keys[slot[go]] = key[go]  # of those that meet in a slot, the last one stays
            self.at[slot[go]] = go
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Rows of keys; -1 where there is none."""
        slot, out, left = self._slot(key), np.full(len(key), -1, np.int64), np.arange(len(key))
        for _ in range(self.probes):
            there = self.keys[slot[left]]
            hit = there == key[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[(there >= 0) & ~hit]
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out
