"""SimHash near-duplicates through a Gray-order hierarchical index.

Texts become 64-bit fingerprints; fingerprints that differ in at most `radius` bits are linked and
connected components are the near-duplicate classes. Two fingerprints within `radius` agree on at
least one of radius + 1 bands of bits, so the top of the index is one shuffle keyed by band and
shared pattern. A group larger than `group_limit` is dealt again by bands of its free bits, until
its size is bounded by the bits left. Within a group, fingerprints are sorted by Gray rank; a node
covers FAN nodes below and keeps the bits that all of them share (mask and pattern). A search goes
down all levels at once and adds up the differences on newly fixed bits; whole nodes whose sum
exceeds the radius are pruned. A group returns a spanning forest of its links, never all pairs.

Nulls: a null text has no words (fingerprint zero). A null doc_id keeps its row; it never is a
component's name unless all ids of the component are null, which gives null. Repeated ids keep
their rows; keep_one keeps one row of each class, also of equal rows. Very long texts are hashed by CHUNK shingles.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscape.llm import text as T
from lexiscape.operators.graph import connected_components
from lexiscape.session import Scratch

RADIUS, SHINGLE, SEED = 4, 4, 42
FAN = 8
GROUP_LIMIT = 20_000
CHUNK = 1 << 16
#: Nodes that a search opens at once (about 60 bytes each).
FRONTIER = 1 << 20


def fingerprint(data: bytes, k: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all k-word shingles, repeats included."""
    from xxhash import xxh64_intdigest as h

    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(words) - k + 1)
    starts, ends = starts[:n].tolist(), (ends[k - 1 :] if len(words) >= k else ends[-1:]).tolist()
    bits = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])), ">u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), fp (the 64 bits as a signed long)."""
    T.bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            raw, off = T.flat(b.column("text"))
            data, off = raw.tobytes(), off.tolist()
            fps = np.fromiter((fingerprint(data[s:e]) for s, e in zip(off, off[1:])), np.uint64, b.num_rows)
            yield pa.record_batch([b.column("doc_id"), b.column("mark"), pa.array(fps.view(np.int64))], names=["doc_id", "mark", "fp"])

    return T.id_text(docs, mark()).mapInArrow(each, "doc_id long, mark long, fp long")


def mark() -> F.Column:
    """What tells rows of one doc_id apart: equal for equal texts only."""
    return F.xxhash64(F.col("text").cast("string")).alias("mark")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(s))
    return fp


def _deal(radius: int):
    """Each row to radius + 1 bands of its free bits."""

    def each(batches):
        for b in batches:
            fp, key, free = (b.column(c).to_numpy().view(np.uint64) for c in ("fp", "key", "free"))
            out = []
            for m in np.unique(free):
                own = free == m
                at = [i for i in range(64) if int(m) >> i & 1]
                for band in np.array_split(np.array(at, np.int64), radius + 1):
                    bm = np.uint64(sum(1 << int(i) for i in band))
                    k = T.mix(T.mix(key[own] + bm) ^ (fp[own] & bm))
                    out.append((fp[own], k, np.full(own.sum(), m & ~bm)))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*out)], names=["fp", "key", "free"])

    return each


class Index:
    """Hierarchical index over groups of fingerprints, sorted by group and Gray rank."""

    def __init__(self, fp: np.ndarray, group: np.ndarray, fan: int = FAN):
        n = len(fp)
        place = np.arange(n) - np.searchsorted(group, group)
        self.fp, self.levels = fp, []
        ones, zeros, node = fp, ~fp, np.arange(n)
        last = node
        while True:
            place = place // fan
            new = np.ones(len(place), bool)
            g = group if len(group) == len(place) else g_here
            new[1:] = (place[1:] != place[:-1]) | (g[1:] != g[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(place)))
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            last = last[first + count - 1]
            self.levels.append((first, count, ones | zeros, ones, last))
            place, g_here = place[first], g[first]
            if not place.any():
                break
        self.root = np.searchsorted(g_here, group)

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of one group within the radius.

        A search that would open more than FRONTIER nodes at once goes on in two halves, so that a dense
        cluster takes more steps, not more memory.
        """
        for at in range(0, len(self.fp), CHUNK >> 2):
            q = np.arange(at, min(at + (CHUNK >> 2), len(self.fp)))
            node = self.root[q]
            _, _, mask, value, _ = self.levels[-1]
            got = np.bitwise_count((self.fp[q] ^ value[node]) & mask[node])
            work = [(len(self.levels) - 1, q, node, got)]
            while work:
                level, q, node, got = work.pop()
                first, count, mask = self.levels[level][:3]
                c = count[node]
                total = int(c.sum())
                if total > FRONTIER and len(q) > 1:
                    half = len(q) >> 1
                    work += [(level, q[half:], node[half:], got[half:]), (level, q[:half], node[:half], got[:half])]
                    continue
                child = np.repeat(first[node] - np.cumsum(c) + c, c) + np.arange(total)
                q, got, fixed = np.repeat(q, c), np.repeat(got, c), np.repeat(mask[node], c)
                if level:
                    _, _, mask, value, last = self.levels[level - 1]
                    keep = last[child] > q
                    q, got, fixed, child = q[keep], got[keep], fixed[keep], child[keep]
                    m, v = mask[child], value[child]
                else:
                    keep = child > q
                    q, got, fixed, child = q[keep], got[keep], fixed[keep], child[keep]
                    m, v = ~np.uint64(0), self.fp[child]
                got = got + np.bitwise_count((self.fp[q] ^ v) & (m & ~fixed))
                keep = got <= radius
                q, child, got = q[keep], child[keep], got[keep]
                if len(q):
                    if level:
                        work.append((level - 1, q, child, got))
                    else:
                        yield q, child


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components by hooking and pointer jumping; parent[i] <= i."""
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            return parent
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def forest(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, representative) that connect what is connected within each group."""
    order = np.lexsort((gray_rank(fp), group))
    fp, group = fp[order], group[order]
    parent = np.arange(len(fp))
    for a, b in Index(fp, group).pairs(radius):
        parent = _merge(parent, a, b)
    own = np.flatnonzero(parent != np.arange(len(fp)))
    return fp[own], fp[parent[own]]


def _linked(radius: int, whole: int = 200_000):
    """Links of a partition sorted by key; whole groups are taken, about `whole` rows at a time."""

    def each(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush(last):
            fp, key = (np.concatenate(x) for x in zip(*held))
            cut = len(key) if last else int(np.searchsorted(key.view(np.int64), key[-1].view(np.int64)))
            held[:] = [(fp[cut:], key[cut:])]
            if cut:
                a, b = forest(fp[:cut], key[:cut], radius)
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append(tuple(b.column(c).to_numpy().view(np.uint64) for c in ("fp", "key")))
                rows += b.num_rows
                if rows >= whole:
                    yield from flush(False)
                    rows = len(held[0][0])
        if held:
            yield from flush(True)

    return each


def links(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b): for each group, a spanning forest of the links between different fingerprints."""
    found, rows = None, fps.select("fp").distinct().select("fp", F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("free"))
    rows = scratch.table(rows)
    while True:
        dealt = rows.mapInArrow(_deal(radius), "fp long, key long, free long")
        hot = scratch.table(dealt.where(F.bit_count("free") > 3 * (radius + 1)).groupBy("key").count().where(F.col("count") > group_limit).select("key"))
        more = not hot.isEmpty()
        now = dealt.join(hot, "key", "left_anti") if more else dealt
        part = scratch.table(now.select("fp", "key").repartition("key").sortWithinPartitions("key").mapInArrow(_linked(radius), "a long, b long").distinct())
        found = part if found is None else found.unionByName(part)
        if not more:
            return found
        rows = scratch.table(dealt.join(hot, "key", "left_semi").select("fp", "key", "free"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, mark, fp, component_id (smallest doc_id reachable over links), first_mark (the mark of that row; ties: the smallest)."""
    scratch = Scratch(docs.sparkSession)
    fps = scratch.table(fingerprints(docs))
    comp = connected_components(links(fps, scratch, radius, group_limit), scratch)
    # One row a fingerprint is joined and summed; copies never meet in one task.
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    own = fps.groupBy("fp").agg(F.min(first).alias("low"))
    own = scratch.table(own.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root")))
    names = own.groupBy("root").agg(F.min("low").alias("first"))
    classes = scratch.table(own.join(names, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.mark").alias("first_mark")))
    return fps.join(classes, "fp").select("doc_id", "mark", "fp", "component_id", "first_mark")


def hex16(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class: the one with the smallest doc_id (null ids last, then the smallest mark; of equal rows, one)."""
    scratch = Scratch(docs.sparkSession)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("mark").eqNullSafe(F.col("first_mark"))
    found = near_duplicates(docs).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.first(stays).alias("_stays"), F.count("*").alias("_rows"))
    found = scratch.table(found.where(~F.col("_stays") | (F.col("_rows") > 1)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (mark() == F.col("_mark"))
    out = docs.join(T.sent(found.drop("_stays", "_rows")), same, "left_anti")
    twice = found.where("_stays").select("_id", "_mark")
    if twice.isEmpty():
        return out
    twice = docs.withColumn("_key", mark()).join(T.sent(twice), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_mark")))
    return out.unionByName(twice.dropDuplicates(["_id", "_mark"]).drop("_key", "_id", "_mark"))
