"""Benchmark contamination by a prefix-filtered join of shingles over windows of item size.

A window is `window` consecutive words of a benchmark item (all of a shorter one). A window occurs in a
document only if every shingle of it does, so any one shingle finds it: shingles are ordered by rarity
(count over all documents) and only the rarest of each window, its prefix, is joined. A posting of the
prefix at a word gives one possible start of the window; starts that would cross the document's bounds
are dropped (length bound), and the other shingles must stand at their own places (positional bound
and exact verification; postings were compared word by word when they were found, so hashes decide
nothing). Texts are read once: the first pass writes, per document, the postings of shingles that
benchmark items have; rarity and join work on that table.

The benchmark goes to the tasks in blocks of at most BLOCK_SHINGLES shingles; a larger benchmark takes
several passes over rows that are numbered and written once, and the hits of all passes are united.

Nulls: null or wordless documents have n_words 0 and no hits; items with null text, no words or null
id take no part; a null doc_id is carried; repeated ids are judged row by row; equal items count each
id once. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscape.llm import text as T
from lexiscape.llm.simhash import mark
from lexiscape.session import Scratch

WINDOW, SHINGLE = 13, 5
BLOCK_SHINGLES = 500_000
#: Contaminated: 20 * n_hit >= n_words.
SHARE = 20

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(text: str | None) -> list[bytes]:
    raw = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = T.runs(_WORD[raw], np.array([0, len(raw)]))
    data = raw.tobytes()
    return [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


class Windows:
    """Shingles and windows of a block of items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, shingle: int):
        self.shingles: dict[tuple[bytes, ...], int] = {}
        seen: dict[tuple[bytes, ...], int] = {}
        self.sequences: list[list[int]] = []
        self.lengths: list[int] = []
        self.owners: list[set[str]] = []
        for item, words in items:
            n = min(window, len(words))
            k = min(shingle, n)
            for i in range(len(words) - n + 1):
                w = tuple(words[i : i + n])
                if w not in seen:
                    seen[w] = len(self.sequences)
                    self.sequences.append([self.shingles.setdefault(w[j : j + k], len(self.shingles)) for j in range(n - k + 1)])
                    self.lengths.append(n)
                    self.owners.append(set())
                self.owners[seen[w]].add(item)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.words = list(self.shingles)
        for k in sorted({len(s) for s in self.words}):
            own = np.array([i for i, s in enumerate(self.words) if len(s) == k])
            data = b" ".join(b" ".join(self.words[i]) for i in own)
            raw = np.frombuffer(data, np.uint8)
            starts, ends, _ = T.runs(_WORD[raw], np.array([0, len(raw)]))
            h = T.shingle_hashes(T.run_hashes(raw, starts, ends), k)[::k]
            order = np.argsort(h, kind="stable")
            self.by_size[k] = h[order], own[order]
        self.shingles = {}

    def prefix(self, counts: np.ndarray) -> None:
        """Joins each window by its rarest shingle (ties: the first)."""
        at = [min(range(len(s)), key=lambda j: (counts[s[j]], j)) for s in self.sequences]
        token = np.array([s[j] for s, j in zip(self.sequences, at)], np.int64)
        order = np.argsort(token, kind="stable")
        self.joined = token[order], order, np.array(at, np.int64)[order]
        self.flat = np.array([x for s in self.sequences for x in s], np.int64)
        self.size = np.array([len(s) for s in self.sequences], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.length = np.array(self.lengths, np.int64)
        self.step = np.array([len(self.words[s[0]]) for s in self.sequences], np.int64)


def _postings(shared):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = shared.value
        seen = {}
        for k, (h, _) in w.by_size.items():
            seen[k] = np.zeros(1 << 22, bool)
            seen[k][h & np.uint64((1 << 22) - 1)] = True
        for b in T.slices(batches):
            raw, off = T.flat(b.column("text"))
            raw = _LOWER[raw]
            starts, ends, doc = T.runs(_WORD[raw], off)
            hashes = T.run_hashes(raw, starts, ends)
            n_words = np.bincount(doc, minlength=b.num_rows)
            first = np.cumsum(n_words) - n_words
            found = []
            data = None
            for k, (h, own) in w.by_size.items():
                s = T.shingle_hashes(hashes, k)
                at = np.flatnonzero(seen[k][s & np.uint64((1 << 22) - 1)])
                at = at[doc[at] == doc[at + k - 1]]
                if not len(at):
                    continue
                data = data or raw.tobytes()
                lo, hi = np.searchsorted(h, s[at], "left"), np.searchsorted(h, s[at], "right")
                for i, a, z in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                    here = tuple(data[starts[j] : ends[j]] for j in range(i, i + k))
                    found += [(int(doc[i]), i - int(first[doc[i]]), int(own[c])) for c in range(a, z) if w.words[own[c]] == here]
            got = np.array(sorted(found), np.int64).reshape(-1, 3)
            cuts = np.searchsorted(got[:, 0], np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(got[:, c].astype(np.int32))) for c in (1, 2)]
            yield pa.record_batch([b.column("row"), b.column("doc_id"), b.column("mark"), pa.array(n_words.astype(np.int64)), *lists], names=["row", "doc_id", "mark", "n_words", "pos", "tok"])

    return each


def _hits(shared):
    """Windows that occur: spans of words and owners, per document with postings."""

    def each(batches):
        w: Windows = shared.value
        token, window, place = w.joined
        for b in batches:
            if not b.num_rows:
                continue
            off = b.column("pos").offsets.to_numpy().astype(np.int64)
            pos, tok = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("pos", "tok"))
            doc = np.repeat(np.arange(b.num_rows), np.diff(off))
            n_words = b.column("n_words").to_numpy()
            lo, hi = np.searchsorted(token, tok, "left"), np.searchsorted(token, tok, "right")
            src = np.repeat(np.arange(len(tok)), hi - lo)
            c = np.repeat(lo, hi - lo) + np.arange(len(src)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            win, start, d = window[c], pos[src] - place[c], doc[src]
            ok = (start >= 0) & (start + w.length[win] <= n_words[d])
            win, start, d = win[ok], start[ok], d[ok]
            order = np.lexsort((tok, pos, doc))
            packed = np.rec.fromarrays([doc[order], pos[order], tok[order]], names="d,p,t")
            alive = np.ones(len(win), bool)
            for j in range(int(w.size.max()) if len(w.size) else 0):
                need = alive & (w.size[win] > j)
                if not need.any():
                    break
                i = np.flatnonzero(need)
                alive[i] = _among(packed, d[i], start[i] + j, w.flat[w.first[win[i]] + j])
            win, start, d = win[alive], start[alive], d[alive]
            spans: list[list] = [[] for _ in range(b.num_rows)]
            items: list[set] = [set() for _ in range(b.num_rows)]
            for x, s, e, k in zip(d.tolist(), start.tolist(), (start + w.length[win]).tolist(), win.tolist()):
                spans[x].append((s, e))
                items[x] |= w.owners[k]
            flat = [[p for s in sorted(set(x)) for p in s] for x in spans]
            yield pa.record_batch([b.column("row"), pa.array(flat, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["row", "spans", "items"])

    return each


def _among(packed, d, p, t) -> np.ndarray:
    """Which (document, place, shingle) are among the sorted postings."""
    if not len(packed):
        return np.zeros(len(d), bool)
    base = np.int64(packed.p.max() + 2)
    key = packed.d * base + packed.p
    # shingles of different lengths may share a place: look through the few at it
    p = np.minimum(p, base - 1)
    lo, hi = np.searchsorted(key, d * base + p, "left"), np.searchsorted(key, d * base + p, "right")
    out = np.zeros(len(d), bool)
    for j in range(int((hi - lo).max()) if len(d) else 0):
        at = np.minimum(lo + j, len(key) - 1)
        out |= (lo + j < hi) & (packed.t[at] == t)
    return out


def _items(benchmark: DataFrame, window: int, shingle: int, block: int) -> Iterator[Windows]:
    held, n = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    for r in rows.toLocalIterator():
        words = words_of(r["text"])
        for at in range(0, max(1, len(words) - window + 1), block):  # an item longer than a block goes by parts
            part = words[at : at + block + window - 1]
            if not part:
                continue
            if held and n + len(part) > block:
                yield Windows(held, window, shingle)
                held, n = [], 0
            held.append((r["item"], part))
            n += len(part)
    yield Windows(held, window, shingle)


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK_SHINGLES) -> DataFrame:
    """row, doc_id, mark, n_words, spans (flat word bounds of hits), items, per document."""
    spark = docs.sparkSession
    T.bounded_batches(spark)
    scratch, base, hits = Scratch(spark), None, None
    blocks = _items(benchmark, window, shingle, block)
    blocks = list(islice(blocks, 2)), blocks
    rows = T.id_text(docs, mark(), F.monotonically_increasing_id().alias("row"))
    if len(blocks[0]) > 1:  # the passes must agree on the rows' numbers
        rows = scratch.table(rows)
    for w in chain(*blocks):
        shared = spark.sparkContext.broadcast(w)
        found = scratch.table(rows.mapInArrow(_postings(shared), "row long, doc_id long, mark long, n_words long, pos array<int>, tok array<int>"))
        counts = np.zeros(len(w.words), np.int64)
        for r in found.select(F.explode("tok").alias("tok")).groupBy("tok").count().toLocalIterator():  # a row a shingle of the block
            counts[r["tok"]] = r["count"]
        w.prefix(counts)
        now = found.where(F.size("pos") > 0).select("row", "n_words", "pos", "tok").mapInArrow(_hits(spark.sparkContext.broadcast(w)), "row long, spans array<long>, items array<string>")
        now = now.where(F.size("spans") > 0)
        base = found.select("row", "doc_id", "mark", "n_words") if base is None else base
        hits = now if hits is None else hits.unionByName(now)
    hits = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return base.join(hits, "row", "left")


def _covered(batches):
    for b in batches:
        n = []
        for x in b.column("spans").to_pylist():
            at = total = 0
            for s, e in sorted(zip(x[::2], x[1::2])) if x else ():
                total += max(0, e - max(s, at))
                at = max(at, e)
            n.append(total)
        yield pa.record_batch([b.column("doc_id"), b.column("mark"), b.column("n_words"), pa.array(n, pa.int64()), b.column("items")], names=["doc_id", "mark", "n_words", "n_hit", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, mark (a hash of the text), n_words, n_hit, n_items, items, contaminated, per row of docs."""
    found = judge(docs, benchmark, **how).mapInArrow(_covered, "doc_id long, mark long, n_words long, n_hit long, items array<string>")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select("doc_id", "mark", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), items.alias("items"), ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows that aren't contaminated; each row is judged by its own text, whatever rows share its doc_id."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    bad = T.sent(Scratch(docs.sparkSession).table(bad))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (mark() == F.col("_mark")), "left_anti")
