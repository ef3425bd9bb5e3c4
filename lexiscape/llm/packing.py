"""Best-fit packing of token sequences by bulk-synchronous sweeps.

Documents are cut into pieces of at most `size` tokens. Lengths are whole numbers up to `size`, so the
range-sorted lists of pieces and of gaps have at most `size` runs of equal length each, however many
documents there are. Every task ranks its own pieces within their length; a sum over tasks makes the
ranks global. One superstep takes all pieces of the longest length left: the successor sweep finds
the smallest gap that holds them, the pieces' ranks settle who goes to which of its sequences, the
gaps are updated, and the sweep repeats until none is left. This gives exactly best-fit decreasing.
The sweeps work on runs, not on rows: only the histogram of lengths (at most `size` rows) reaches the
driver, and what goes back is a list of moves (length, ranks, sequences), joined by length and rank
(beyond SENT_MOVES in blocks of BLOCK_RANKS ranks, so that no length is one key).

Nulls: a null text is an empty one (the end id alone); a null doc_id is carried. Repeated ids are
packed row by row. No rows give no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscape.llm import text as T
from lexiscape.llm import tokens as K
from lexiscape.session import Scratch

SIZE, END = 4096, 1
#: Moves up to this number are sent to all tasks (40 bytes each); more are joined by length and block of ranks.
SENT_MOVES = 200_000
#: Ranks of one length that meet their moves under one key.
BLOCK_RANKS = 1 << 16
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, local long"


def pieces(docs: DataFrame, size: int = SIZE, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """Pieces of each text's ids and end id, each with its rank among the task's pieces of its length."""
    T.bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = K.encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for b in T.slices(batches, limit=K.SLICE_BYTES):
            ids, off = K.with_end(*enc.encode(b.column("text")), end)
            n_tokens = np.diff(off)
            count = -(-n_tokens // size)
            doc = np.repeat(np.arange(b.num_rows), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * size
            length = np.minimum(n_tokens[doc] - start, size)
            data, at = ids.tobytes(), (off[doc] + start).tolist()
            crc = np.fromiter((zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist())), np.int64, len(doc))
            order = np.argsort(length, kind="stable")
            own = length[order]
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.searchsorted(own, own) + seen[own]
            seen += np.bincount(length, minlength=size + 1)
            yield pa.record_batch(
                [b.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc), pa.array(np.full(len(doc), task, np.int32)), pa.array(rank)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "local"],
            )

    return T.id_text(docs).mapInArrow(each, PIECES)


def moves(histogram: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over runs.

    Rows (length, first rank, ranks, first sequence, pieces a sequence, offset): piece `rank` goes to
    sequence first + (rank - first rank) // per, at offset + ((rank - first rank) % per) * length.
    Also the number of sequences.
    """
    out: list[tuple[int, ...]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: intervals (first sequence, sequences)
    sizes: list[int] = []  # gaps in ascending order
    used = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted((k for k, v in histogram.items() if v), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, per = size, size // length
                first, n = used, -(-left // per)
                used += n
            per = gap // length
            whole = min(n, left // per)
            if whole:
                out.append((length, rank, whole * per, first, per, size - gap))
                put(gap - per * length, first, whole)
                rank, left, first, n = rank + whole * per, left - whole * per, first + whole, n - whole
            if n and left:  # fewer pieces than the next sequence would hold
                out.append((length, rank, left, first, left, size - gap))
                put(gap - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(gap, first, n)
    return np.array(out, np.int64).reshape(-1, 6), used


def _placed(rows: DataFrame, plan: np.ndarray, sent: int) -> DataFrame:
    """length and rank to sequence_id and offset."""
    spark = rows.sparkSession
    if len(plan) > sent:
        table = spark.createDataFrame([tuple(map(int, x)) for x in plan], "length int, first_rank long, ranks long, first long, per long, base long")
        # A hot length's ranks are joined by blocks; a move is sent to each block that it reaches into.
        table = table.withColumn("block", F.explode(F.expr(f"sequence(first_rank div {BLOCK_RANKS}, (first_rank + ranks - 1) div {BLOCK_RANKS})")))
        rows = rows.withColumn("block", F.expr(f"rank div {BLOCK_RANKS}"))
        found = rows.join(table, ["length", "block"]).where("rank >= first_rank and rank < first_rank + ranks")
        at = F.col("rank") - F.col("first_rank")
        return found.withColumn("sequence_id", F.expr("first + (rank - first_rank) div per")).withColumn("offset", F.col("base") + at % F.col("per") * F.col("length")).select(*OUT)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    shared = spark.sparkContext.broadcast(plan[order])

    def each(batches):
        p = shared.value
        key = p[:, 0] << 48 | p[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column("length").to_numpy().astype(np.int64), b.column("rank").to_numpy()
            m = p[np.searchsorted(key, length << 48 | rank, "right") - 1]
            at = rank - m[:, 1]
            yield pa.record_batch([*(b.column(c) for c in OUT[:3]), pa.array(length), b.column("ids_crc32"), pa.array(m[:, 3] + at // m[:, 4]), pa.array(m[:, 5] + at % m[:, 4] * length)], names=list(OUT))

    return rows.mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


OUT = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack(docs: DataFrame, size: int = SIZE, end: int = END, vocabulary: str | None = None, sent_moves: int = SENT_MOVES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: each piece's place."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.table(pieces(docs, size, end, vocabulary))
    counts = scratch.table(found.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = moves(histogram, size)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    rows = found.join(offsets, ["task", "length"]).withColumn("rank", F.col("local") + F.col("before")).drop("task", "local", "before")
    return _placed(rows, plan, sent_moves).select(*(F.col(c).cast("long") if c != "piece" else F.col(c) for c in OUT))
