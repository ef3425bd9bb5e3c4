"""URL filter: rules, and a character language-model ratio where no rule fits.

Two smoothed variable-order Markov models over the bytes of host and path, one of URLs that rules
accept and one of those they reject, count every labelled URL. Orders 0 to ORDER are interpolated by
Witten-Bell: p_k(c | context) = (n(context c) + t(context) p_{k-1}) / (n(context) + t(context)), where t
counts the different continuations; an unseen context leaves the lower order as it is, so the order
varies with what was seen. Counts are exact, by n-gram, and grow with the labelled URLs. Tasks sum before
anything is shuffled. The table is cut into shards of about SHARD_ROWS n-grams by the two bytes before the last one,
which the orders from 2 on share for a place in a URL (orders 0 and 1 go with every shard); a shard is sent to
the tasks, URLs are read once a shard and log-ratios add up (two bytes with more are cut no further). The decision is the
difference of log-likelihoods a character; its threshold is the one with the best balanced accuracy on
labelled URLs of the calibration fold (crc32(host and path) mod 5 = 0), which the counted fold leaves out.

Rules (host, path): a rule fits its host and all subdomains if the path starts with the rule's; the
longest wins. A null url or one without `://` has empty host and path: no rule fits, the method judges
the empty string (score 0). A page's host is taken as written but for A-Z. With URLs of one class only, every other URL gets
that class; with none, `allow`. Null page_id is carried; equal URLs are judged alike; very long URLs are scored whole; no pages give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscape.llm import text as T
from lexiscape.session import Scratch

#: The query's rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ORDER, SHARD_ROWS, BINS, SPAN = 5, 1_500_000, 4001, 8.0
#: URL text that is worked on at once; a longer URL makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Bits of a symbol (0: the end; a byte + 1; START: before the text), and where a key's order stands.
SYMBOL, START, TAG = 9, 300, 54


def parts(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, listed (the rule's verdict or null)."""
    rest = F.when(F.instr("url", "://") > 0, F.substring_index(F.expr("substr(url, instr(url, '://') + 3)"), "#", 1))
    rest = F.substring_index(rest, "?", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), rest.alias("rest"))
    slash = F.instr("rest", "/")
    out = out.select("page_id", F.coalesce(F.translate(F.when(slash > 0, F.expr("substr(rest, 1, instr(rest, '/') - 1)")).otherwise(F.col("rest")), upper, lower), F.lit("")).alias("host"), F.coalesce(F.when(slash > 0, F.expr("substr(rest, instr(rest, '/'))")), F.lit("")).alias("path"))
    rule, listed = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, r in sorted(rules, key=lambda x: len(x[1])):
        host, _, path = r.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, listed = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(listed)
    return out.select("page_id", "host", "path", rule.alias("rule"), listed.alias("listed"))


def grams(text: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (context, byte), order by order (rows), for every byte and the end (columns); texts' offsets.

    A key is the order and the symbols themselves, SYMBOL bits each: two n-grams never share one. A key without its last
    symbol is its context's.
    """
    raw, off = T.flat(text)
    n = len(off) - 1
    size = np.diff(off) + 1
    ends = np.cumsum(size)
    chars = np.zeros(int(ends[-1]) if n else 0, np.int64)
    body = np.ones(len(chars), bool)
    body[ends - 1] = False
    chars[body] = raw.astype(np.int64) + 1
    place = np.arange(len(chars)) - np.repeat(ends - size, size)
    window, out = chars.copy(), []
    for k in range(order + 1):
        if k:
            back = np.zeros(len(chars), np.int64)
            back[k:] = chars[:-k]
            back[place < k] = START
            window = window | back << (SYMBOL * k)
        out.append(window | np.int64(k) << TAG)
    return np.array(out, np.int64).reshape(order + 1, len(chars)), np.concatenate([[0], ends])


def part_of(key, parts: int):
    """The shard of an n-gram (NumPy or column) of order 2 or more: of the two symbols before its last, which all such orders share."""
    pair = key.bitwiseAND(F.lit((1 << (3 * SYMBOL)) - 1)) if isinstance(key, F.Column) else key & ((1 << (3 * SYMBOL)) - 1)
    pair = F.shiftright(pair, SYMBOL) if isinstance(pair, F.Column) else pair >> SYMBOL
    return pair * 7919 % parts


class Markov:
    """Exact counts of n-grams, and of their contexts and these' continuations, of a class."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        context, where = np.unique(key >> SYMBOL, return_inverse=True)
        self.grams = T.Lookup(key, n.astype(float))
        self.contexts = T.Lookup(context, np.bincount(where, n, len(context)), np.bincount(where, minlength=len(context)).astype(float))

    def log(self, own: np.ndarray) -> np.ndarray:
        p = np.full(own.shape[1], 1 / 257)
        for key in own:
            at = self.contexts.find(key >> SYMBOL)
            seen = np.flatnonzero(at >= 0)
            n, t = (v[at[seen]] for v in self.contexts.values)
            row = self.grams.find(key[seen])
            count = np.zeros(len(seen))
            count[row >= 0] = self.grams.values[0][row[row >= 0]]
            p[seen] = (count + t * p[seen]) / (n + t)
        return np.log(np.maximum(p, 1e-300))


def _count(order: int):
    """Of a task's URLs: per class, n-gram and how often."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "s", SLICE_BYTES):
            kind = np.array([x == "allow" for x in b.column("listed").to_pylist()], bool)
            own, off = grams(b.column("s"), order)
            cls = np.repeat(kind, np.diff(off))
            for allow in (True, False):
                key, n = np.unique(own[:, cls == allow], return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(key), allow)), pa.array(key), pa.array(n)], names=["allow", "key", "n"])

    return each


def _scores(shared, order: int):
    """Sums of log-ratios over the places of a shard."""

    def each(batches):
        allow, block, part, parts = shared.value
        for b in T.slices(batches, "s", SLICE_BYTES):
            own, off = grams(b.column("s"), order)
            ratio = np.zeros(own.shape[1])
            here = np.flatnonzero(part_of(own[-1], parts) == part)
            ratio[here] = allow.log(own[:, here]) - block.log(own[:, here])
            d = np.concatenate([[0.0], np.cumsum(ratio)])
            score = (d[off[1:]] - d[off[:-1]]) / np.maximum(np.diff(off), 1)
            score[np.diff(off) == 1] = 0.0
            yield pa.record_batch([*(b.column(c) for c in (*CARRIED, "row")), pa.array(score)], names=[*CARRIED, "row", "score"])

    return each


CARRIED = ("page_id", "host", "path", "rule", "listed")
SCORED = "page_id long, host string, path string, rule string, listed string, row long, score double"


def judge(pages: DataFrame, rules=RULES, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, score."""
    spark = pages.sparkSession
    T.bounded_batches(spark)
    found = parts(pages, rules).withColumn("s", F.concat("host", "path"))
    calibrates = F.crc32("s") % 5 == 0
    taught = found.where(F.col("listed").isNotNull())
    classes = {r["listed"] for r in taught.select("listed").distinct().collect()}
    scratch = Scratch(spark)
    counted = taught.where(~calibrates).select("s", "listed").mapInArrow(_count(order), "allow boolean, key long, n long")
    counted = scratch.table(counted.groupBy("allow", "key").agg(F.sum("n").alias("n")))
    parts_n = max(1, -(-counted.count() // shard_rows))
    everywhere = F.shiftright("key", TAG) < 2  # at most 257 and 257 * 257 n-grams
    found = scratch.table(found.withColumn("row", F.monotonically_increasing_id())) if parts_n > 1 else found.withColumn("row", F.lit(0).cast("long"))
    scored = None
    for i in range(parts_n):
        own = counted.where(everywhere | (part_of(F.col("key"), parts_n) == i)).toArrow()
        allow, key, n = (own.column(c).to_numpy() for c in ("allow", "key", "n"))
        models = [Markov(key[which], n[which]) for which in (allow.astype(bool), ~allow.astype(bool))]
        shared = spark.sparkContext.broadcast((*models, i, parts_n))
        part = found.mapInArrow(_scores(shared, order), SCORED)
        scored = part if scored is None else scored.unionByName(part)
    if parts_n > 1:
        scored = scratch.table(scored.groupBy("row").agg(*(F.first(c).alias(c) for c in CARRIED), F.sum("score").alias("score")))
    if len(classes) == 2:
        width = 2 * SPAN / BINS
        bins = scored.where(F.col("listed").isNotNull() & (F.crc32(F.concat("host", "path")) % 5 == 0))
        bins = bins.groupBy("listed", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + SPAN) / width))).alias("bin")).count().collect()
        hist = {c: np.zeros(BINS) for c in ("allow", "block")}
        for r in bins:
            hist[r["listed"]][r["bin"]] = r["count"]
        right = np.cumsum(hist["block"]) / max(1, hist["block"].sum()) + 1 - np.cumsum(hist["allow"]) / max(1, hist["allow"].sum())
        best = np.flatnonzero(right >= right.max() - 1e-12)
        threshold = -SPAN + width * (best[len(best) // 2] + 1) if hist["allow"].sum() and hist["block"].sum() else 0.0
        says = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    else:
        says = F.lit(next(iter(classes), "allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("listed", says).alias("verdict"), "score")
