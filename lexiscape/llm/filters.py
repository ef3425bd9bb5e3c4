"""How five quality filters interact: what each removes in every order, what it repeats, what it alone would catch.

Texts are read as Arrow buffers. Byte classes (a table of 256 entries) give word runs, capitals and symbols; prefix sums
over the bytes give each document's counts. Words are hashed, sorted within their document, and neighbours of one hash
compared byte by byte (a document where they differ is counted again by its words themselves), which gives the number of
different words. A document's failures are one mask of five bits, and everything else is sums over masks.

Filters: A under 50 words, B 100 * different words < 65 * words, C 100 * capitals > 5 * code points, D holds a symbol,
E some smaller doc_id has the same text. Words are maximal runs without blanks, and case counts.

Null text is empty (A and, where a smaller id is empty too, E). A null doc_id is smaller than none and follows none; it has no
label. A repeated doc_id is judged row by row, and its rows are no smaller than each other. A null source is the part "". A
document with several labels has a flag if any of its labels has it. Texts of any length are hashed in pieces of PIECE
bytes. An empty table has no parts and no rows. Other columns, also those named like the result's, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscape.llm import text as T

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS = 50, 65, 5
#: Bytes of words that are hashed or compared at once.
PIECE = 4 << 20

_BLANK, _CAPITAL, _SYMBOL, _LATER = 1, 2, 4, 8


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] |= _BLANK
    out[ord("A") : ord("Z") + 1] |= _CAPITAL
    out[list(b"#$%&*|")] |= _SYMBOL
    out[0x80:0xC0] |= _LATER  # bytes after the first of a code point
    return out


_CLASS = _classes()


def _per_document(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marked bytes each document has: differences of prefix sums."""
    upto = np.zeros(len(marked) + 1, np.int64)
    np.cumsum(marked, out=upto[1:])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words with PIECE bytes at most; a longer word is one of its own."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        yield at, stop
        at = stop


def _same(raw: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b on are the same, by pair."""
    out = np.ones(len(a), bool)
    for lo, hi in _pieces(sizes):
        size = sizes[lo:hi]
        first = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(first, size)
        equal = raw[within + np.repeat(a[lo:hi], size)] == raw[within + np.repeat(b[lo:hi], size)]
        out[lo:hi] = np.logical_and.reduceat(equal, first)
    return out


def different_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, documents: int, hashes=T.run_hashes) -> np.ndarray:
    """How many different words each document has."""
    if not len(starts):
        return np.zeros(documents, np.int64)
    sizes = ends - starts
    h = np.concatenate([hashes(raw, starts[lo:hi], ends[lo:hi]) for lo, hi in _pieces(sizes)])
    order = np.lexsort((h, owner))
    h, own, at, size = h[order], owner[order], starts[order], sizes[order]
    again = np.flatnonzero((h[1:] == h[:-1]) & (own[1:] == own[:-1])) + 1
    out = np.bincount(own, minlength=documents) - np.bincount(own[again], minlength=documents)
    even = size[again] == size[again - 1]
    kept = again[even]
    clash = np.concatenate([again[~even], kept[~_same(raw, at[kept], at[kept - 1], size[kept])]])
    for d in np.unique(own[clash]):  # two words with one hash
        lo, hi = np.searchsorted(owner, [d, d + 1])
        out[d] = len({raw[s:e].tobytes() for s, e in zip(starts[lo:hi], ends[lo:hi])})
    return out


def measured(column: pa.Array) -> dict[str, np.ndarray]:
    """words, different, capitals, points, symbols of each text."""
    raw, offsets = T.flat(column)
    kind = _CLASS[raw]
    starts, ends, owner = T.runs((kind & _BLANK) == 0, offsets)
    n = len(offsets) - 1
    count = lambda bit: _per_document((kind & bit) != 0, offsets)
    return {
        "words": np.bincount(owner, minlength=n),
        "different": different_words(raw, starts, ends, owner, n),
        "capitals": count(_CAPITAL),
        "points": np.diff(offsets) - count(_LATER),
        "symbols": count(_SYMBOL),
    }


def text_mask(m: dict[str, np.ndarray]) -> np.ndarray:
    """Bits 0 to 3: failures of A to D."""
    fails = (m["words"] < LEAST_WORDS, 100 * m["different"] < LEAST_DIFFERENT * m["words"], 100 * m["capitals"] > MOST_CAPITALS * m["points"], m["symbols"] > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (failures of A to D), digest of the text, per row."""
    T.bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            raw, offsets = T.flat(b.column("text"))
            view = memoryview(raw)
            digest = [hashlib.sha256(view[s:e]).digest() for s, e in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch([b.column("doc_id"), b.column("part"), pa.array(text_mask(measured(b.column("text"))), pa.int32()), pa.array(digest, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    return T.id_text(docs, part).mapInArrow(each, "doc_id long, part string, mask int, digest binary")


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (five bits), good, toxic, n.

    Rows meet their labels by doc_id. Copies of a text are summed by part and flags before they meet, each sum with its smallest
    doc_id and the rows that have it: of a text's rows, only those of the smallest id of all pass E.
    """
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    own = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = masks(docs).join(own, "doc_id", "left").fillna(0, ["good", "toxic"])
    keys = ["digest", "part", "mask", "good", "toxic"]
    one = rows.groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    few = one.groupBy(*keys).agg(F.min(known).alias("low"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("loose"))
    low = few.groupBy("digest").agg(F.min("low.doc_id").alias("least"))
    t = few.join(low, "digest")
    first = F.col("loose") + F.when(F.col("low.doc_id") == F.col("least"), F.col("low.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask"), first.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - first).alias("n"))))
    return t.select("part", "good", "toxic", split.alias("x")).where("x.n > 0").groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.n").alias("n"))


def _orders() -> list[tuple[str, int, int, int]]:
    """filter_order, step, bit of its filter, bits of those before: 600 rows."""
    out = []
    for order in permutations(LETTERS):
        before = 0
        for step, x in enumerate(order, 1):
            bit = 1 << LETTERS.index(x)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and what the step's filter does there (see the contract of op13).

    Sums are made once for each filter and set of filters before it (80 of them), and then named by the 120 orders.
    """
    spark = docs.sparkSession
    orders = _orders()
    cases = sorted({(bit, before) for _, _, bit, before in orders})
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("bit"), F.lit(s).alias("before")) for b, s in cases)))
    t = histogram(docs, labels).withColumn("x", each).select("*", "x.bit", "x.before")
    has, earlier = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    sums = t.groupBy("part", "bit", "before").agg(
        total(~has & ~earlier).alias("kept"),
        total(has & ~earlier).alias("removed"),
        total(has & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(has & ~earlier & (F.col("good") == 1)).alias("good_lost"),
        total(has & ~earlier & (F.col("toxic") == 1)).alias("toxic_lost"),
        F.sum(F.when(has, F.col("n") * (F.lit(120) / F.bit_count("mask")).cast("long")).otherwise(0)).cast("long").alias("shapley"),  # first of its failures in 120 / k orders
    )
    named = spark.createDataFrame(orders, "filter_order string, step int, bit int, before int")  # 600 rows
    return sums.join(F.broadcast(named), ["bit", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
