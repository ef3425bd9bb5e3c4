"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

Units are the tokens of a public vocabulary (a parameter), so that everything of order 1 has at most VOCABULARY rows,
and a bigram is an exact 32-bit key. Every trusted document outside the calibrating fold is counted; tasks sum before
anything is shuffled, and the table of bigrams grows with the trusted text. Order 1 has continuation counts (the number
of different tokens before a token), interpolated with equal shares of the mass that Good and Turing give to tokens that
were never seen (the share of tokens that stand once); discounts are the modified ones, from counts of counts over the whole tables.

With p(w|v) = (c(vw) - d) / c(v) + g(v) p(w), the log-likelihood of a text is a sum over its places of log g(v) + log p(w),
which are of order 1, and of bonus(vw) = log p(w|v) - log g(v) - log p(w), which is zero for a bigram that wasn't seen. So
scoring is a sharded count join: a task encodes a slice of texts, adds up what is of order 1, sorts the slice's bigrams
and sends each shard its own ones once, with the documents that they stand in (a block: sorted keys and documents in
compressed byte planes). A shard looks the keys up in its part of the table and returns sums by document. Shards are
hash classes of bigrams, as many as the table needs at SHARD_ROWS each, and a shard's blocks are dealt to buckets of
BUCKET_BYTES of text, so that no task has more than a part of the table and a bucket's blocks, whatever the size; a
bigram that stands in most documents is one key and a list of documents in each slice's block.

Trusted: labelled quality 1 and not toxic (a document with several labels is trusted if one row says so). Ids of trusted
documents are sent to the tasks while there are at most SENT_IDS; more are joined by a sort.
One in FOLDS of the trusted documents (crc32 of the id) is left out of the counts and calibrates, since a
model finds the text it was made from too likely. A few words that trusted text never has hardly move the perplexity of
a long text, so the share of its tokens that the model has not seen is judged too: above the QUANTILE quantile of the
calibrating trusted documents it isn't kept. Labelled rejects (quality 0 or toxic, and not trusted) of the same
fold calibrate the perplexity of the rest: a language's threshold is the perplexity (in bins of BIN of its logarithm) with the largest
share of rejects above it less COST times the share of trusted ones above it (ties: the largest). Where a side has fewer than
SIDE documents it is the QUANTILE of the calibrating trusted documents (of all trusted ones where none
calibrates); languages without trusted documents (null counts as one) take the threshold of all. Degenerate text is
too likely: perplexity below the 1 - QUANTILE quantile of the calibrating trusted documents isn't kept either. A language
with fewer than LOW calibrating trusted documents takes this bound and that of unseen tokens from those of all languages;
where all have fewer, there is neither. Texts without tokens (null, empty, white space)
have perplexity null and are not kept. Without trusted text every token is equally likely, there is no threshold and all
with tokens are kept. Very long texts make slices of their own. Repeated rows and ids keep their rows, an empty table
gives none. Extra columns are ignored. docs must give the same rows in the same order when a task is repeated, as
scans and written tables do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscape.llm import text as T
from lexiscape.llm import tokens as K
from lexiscape.session import Scratch

QUANTILE, FOLDS, SHARD_ROWS, BUCKET_BYTES = 0.99, 5, 2_000_000, 64 << 20
#: Largest vocabulary: a bigram is two 16-bit numbers, the last of which stands for a text's start.
VOCABULARY = (1 << 16) - 1
#: Bins of log-perplexity; calibrating documents of either side for a two-sided threshold, trusted ones for a lower bound.
BIN, SIDE, LOW = 0.001, 10, 100
#: What the loss of a share of trusted documents weighs against the same share of rejects kept.
COST = 4
#: Ids of trusted documents that may be sent to the tasks.
SENT_IDS = 2_000_000
#: Thresholds up to this number of languages are sent to all tasks; more are joined, with scores dealt to SALTS parts a language.
SENT_LANGS, SALTS = 10_000, 64


def grams(column: pa.Array, vocabulary: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each token of all texts the bigram that ends in it (token before << 16 | token), and texts' offsets."""
    enc = K.encoder(vocabulary)
    start = len(enc.ends)
    if start > VOCABULARY:
        raise ValueError(f"the vocabulary has more than {VOCABULARY} tokens")
    ids, off = enc.encode(column)
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[off[:-1][np.diff(off) > 0]] = start
    return before << 16 | ids, off


def _counted(vocabulary: str | None):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in T.slices(batches, limit=K.SLICE_BYTES):
            k, n = np.unique(grams(b.column("text"), vocabulary)[0], return_counts=True)
            have, where = np.unique(np.concatenate([have, k]), return_inverse=True)
            total = np.bincount(where, np.concatenate([total, n]), len(have)).astype(np.int64)
            if len(have) > 2_000_000:
                yield pa.record_batch([pa.array(have), pa.array(total)], names=["gram", "n"])
                have, total = have[:0], total[:0]
        yield pa.record_batch([pa.array(have), pa.array(total)], names=["gram", "n"])

    return each


def counts(trusted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """gram, n over all trusted texts."""
    T.bounded_batches(trusted.sparkSession)
    return trusted.mapInArrow(_counted(vocabulary), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discount(of: np.ndarray) -> np.ndarray:
    """The modified discounts of counts 0, 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to 4 (at 1 to 4)."""
    y = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
    return np.array([0.0] + [min(max(c - (c + 1) * y * of[c + 1] / of[c], 0.1), c - 0.05) if of[c] and of[c + 1] else 0.5 for c in (1, 2, 3)])


class Low:
    """What is of order 1, in arrays by token: p(w), and of a token as context c(v) and g(v)."""

    def __init__(self, table: DataFrame, vocabulary: str | None = None):
        size = len(K.encoder(vocabulary).ends)
        once = [F.count(F.when(F.col("n") == c, 1)).alias(f"n{c}") for c in (1, 2, 3, 4)]
        before = table.groupBy(F.shiftright("gram", 16).alias("v")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), *once).collect()  # at most VOCABULARY + 1 rows
        after = table.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("w")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect()  # at most VOCABULARY rows
        self.discount = discount(np.array([0.0] + [sum(r[f"n{c}"] for r in before) for c in (1, 2, 3, 4)]))
        self.context, self.back = np.zeros(size + 1), np.ones(size + 1)
        for r in before:
            d = self.discount[1] * r["n1"] + self.discount[2] * r["n2"] + self.discount[3] * (r["kinds"] - r["n1"] - r["n2"])
            self.context[r["v"]], self.back[r["v"]] = r["n"], d / r["n"]
        one, own = np.zeros(size), np.zeros(size)
        for r in after:
            one[r["w"]], own[r["w"]] = r["kinds"], r["n"]
        self.unseen = own == 0
        kept = one - discount(np.bincount(np.minimum(one, 5).astype(int), minlength=6).astype(float))[np.minimum(one, 3).astype(int)]
        new = max(1.0, (own == 1).sum()) / max(1.0, own.sum())
        self.p = (1 - new) * kept / kept.sum() + new / size if len(after) else np.full(size, 1 / size)

    def places(self, gram: np.ndarray) -> np.ndarray:
        """log g(v) + log p(w)."""
        return np.log(self.back)[gram >> 16] + np.log(self.p)[gram & 0xFFFF]

    def bonus(self, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a seen bigram adds."""
        v, low = gram >> 16, self.back[gram >> 16] * self.p[gram & 0xFFFF]
        return np.log(((n - self.discount[np.minimum(n, 3)]) / self.context[v] + low) / low)


def packed(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays as compressed byte planes, with what it takes to read them."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    planes = [press.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) for a in arrays]
    head = np.array([len(arrays), *(x for a, p in zip(arrays, planes) for x in (a.itemsize, len(a), len(p)))], "<u4")
    return head.tobytes() + b"".join(planes)


def unpacked(body: bytes) -> list[np.ndarray]:
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    k = int(np.frombuffer(body, "<u4", 1)[0])
    head, at, out = np.frombuffer(body, "<u4", 3 * k, 4).reshape(k, 3).tolist(), 4 + 12 * k, []
    for item, n, size in head:
        raw = open_.decompress(body[at : at + size], max_output_size=max(1, item * n)) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(item, n).T).view(f"<u{item}").ravel())
        at += size
    return out


def shard_of(gram, shards: int):
    """The shard of a bigram (NumPy or column)."""
    if isinstance(gram, np.ndarray):
        return (gram * 1640531527 >> 16) % shards
    return (F.shiftright(gram * F.lit(1640531527), 16) % F.lit(shards)).cast("int")


BLOCK = "shard int, bucket int, slice long, body binary, docs array<struct<doc_id:long,lang:string,ll:double,size:long,unseen:long>>"
_DOC = pa.struct([("doc_id", pa.int64()), ("lang", pa.string()), ("ll", pa.float64()), ("size", pa.int64()), ("unseen", pa.int64())])
_BLOCK = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("slice", pa.int64()), ("body", pa.binary()), ("docs", pa.list_(_DOC))])


def _asked(low, shards: int, buckets: int, vocabulary: str | None):
    """Blocks of a task's slices; shard 0's carry the slice's documents with what is of order 1."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, task = low.value, TaskContext.get().partitionId()
        for i, b in enumerate(T.slices(batches, limit=K.SLICE_BYTES)):
            gram, off = grams(b.column("text"), vocabulary)
            sums = np.concatenate([[0.0], np.cumsum(model.places(gram))])
            new = np.concatenate([[0], np.cumsum(model.unseen[gram & 0xFFFF])])
            docs = pa.StructArray.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(sums[off[1:]] - sums[off[:-1]]), pa.array(np.diff(off)), pa.array(new[off[1:]] - new[off[:-1]])], fields=list(_DOC))
            doc = np.repeat(np.arange(b.num_rows), np.diff(off))
            key = np.sort(gram << 24 | doc)
            gram, doc = key >> 24, (key & 0xFFFFFF).astype(np.uint16 if b.num_rows <= 1 << 16 else np.uint32)
            shard = shard_of(gram, shards)
            rows = []
            for s in range(shards):
                g, d = (gram, doc) if shards == 1 else (gram[shard == s], doc[shard == s])
                first = np.flatnonzero(np.diff(g, prepend=-1))
                body = packed(np.diff(g[first], prepend=0).astype(np.uint32), np.diff(first, append=len(g)).astype(np.uint32), d)
                if len(g) or not s:
                    rows.append((s, (task * 7919 + i) % buckets, task << 32 | i, body))
            head = [pa.array(x, f.type) for x, f in zip(zip(*rows), _BLOCK)]
            ends = pa.array([0] + [b.num_rows] * len(rows), pa.int32())
            yield pa.record_batch([*head, pa.ListArray.from_arrays(ends, docs)], schema=_BLOCK)

    return each


ANSWER = "slice long, at int, doc_id long, lang string, ll double, size long, unseen long"
_ANSWER = pa.schema([("slice", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("lang", pa.string()), ("ll", pa.float64()), ("size", pa.int64()), ("unseen", pa.int64())])


def _answered(blocks: pa.Table, table: pa.Table) -> pa.Table:
    """Sums by document of a bucket's blocks, from the shard's part of the table."""
    out, bonus = [], T.Lookup(np.zeros(0, np.int64), np.zeros(0))
    for body in table.column("body").to_pylist():
        step, value = unpacked(body)
        bonus = T.Lookup(np.cumsum(step.astype(np.int64)), value.view(np.float64))
    for i in range(blocks.num_rows):
        step, times, doc = unpacked(blocks.column("body")[i].as_py())
        row = bonus.find(np.cumsum(step.astype(np.int64)))
        gain = np.where(row >= 0, bonus.values[0][row] if len(bonus.values[0]) else 0.0, 0.0)
        sums = np.bincount(doc, np.repeat(gain, times))
        name = blocks.column("slice")[i].as_py()
        docs = blocks.column("docs")[i].values
        if blocks.column("shard")[i].as_py() == 0:
            sums = np.concatenate([sums, np.zeros(len(docs) - len(sums))])
            own = docs.flatten()
            cols = [pa.array(np.full(len(docs), name)), pa.array(np.arange(len(docs), dtype=np.int32)), own[0], own[1], pa.array(own[2].to_numpy() + sums), own[3], own[4]]
        else:
            at = np.flatnonzero(sums)
            cols = [pa.array(np.full(len(at), name)), pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.string()), pa.array(sums[at]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64())]
        out.append(pa.table(cols, schema=_ANSWER))
    return pa.concat_tables(out) if out else _ANSWER.empty_table()


def _parts(low):
    def each(own: pa.Table) -> pa.Table:
        gram, n = (own.column(c).to_numpy() for c in ("gram", "n"))
        order = np.argsort(gram)
        gram, n = gram[order], n[order]
        body = packed(np.diff(gram, prepend=0).astype(np.uint32), low.value.bonus(gram, n).view(np.uint64))
        return pa.table({"shard": pa.array([own.column("shard")[0].as_py()], pa.int32()), "body": pa.array([body], pa.binary())})

    return each


def scores(rows: DataFrame, table: DataFrame, vocabulary: str | None = None, shard_rows: int = SHARD_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, lang, ll, size, unseen (tokens that trusted text has not) of each of rows (doc_id, text, lang), by the counts of table (gram, n), which must be a written one."""
    spark = rows.sparkSession
    T.bounded_batches(spark)
    low = spark.sparkContext.broadcast(Low(table, vocabulary))  # by token: bounded by VOCABULARY
    shards = max(1, -(-table.count() // shard_rows))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // (shards * bucket_bytes)))
    asked = rows.mapInArrow(_asked(low, shards, buckets, vocabulary), BLOCK)
    parts = table.withColumn("shard", shard_of(F.col("gram"), shards)).groupBy("shard").applyInArrow(_parts(low), "shard int, body binary")
    parts = parts.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    found = asked.groupBy("shard", "bucket").cogroup(parts.groupBy("shard", "bucket")).applyInArrow(_answered, ANSWER)
    whole = F.first(F.when(F.col("size").isNotNull(), F.struct("doc_id", "lang", "size", "unseen")), ignorenulls=True).alias("doc")
    return found.groupBy("slice", "at").agg(whole, F.sum("ll").alias("ll")).select("doc.doc_id", "doc.lang", "ll", "doc.size", "doc.unseen")


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, vocabulary: str | None = None, shard_rows: int = SHARD_ROWS, bucket_bytes: int = BUCKET_BYTES, sent_ids: int = SENT_IDS) -> DataFrame:
    """doc_id, lang, perplexity, threshold, unseen (a share of the tokens), unseen_threshold, keep, per row of docs."""
    scratch = Scratch(docs.sparkSession)
    fine = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    poor = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    sides = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(fine).alias("trusted"), F.max(poor).alias("poor"))
    sides = scratch.table(sides.select("doc_id", "trusted", (F.col("poor") & ~F.col("trusted")).alias("rejected")))
    good = sides.where("trusted and doc_id is not null").select("doc_id")
    good = F.broadcast(good) if good.count() <= sent_ids else good.hint("merge")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    trusted = rows.where(~calibrates()).select("doc_id", "text").join(good, "doc_id", "left_semi")
    table = scratch.table(counts(trusted.select("text"), vocabulary))
    found = scratch.table(scores(rows, table, vocabulary, shard_rows, bucket_bytes))
    marked = found.join(sides, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("trusted", "rejected")})
    return _thresholded(marked, quantile)


def calibrates() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _two_sided(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, cut: the log-perplexity that parts trusted from rejected calibrating documents best; null with too few of a side."""
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in ("trusted", "rejected")]
    bins = scored.where(calibrates() & (F.col("trusted") | F.col("rejected")) & F.col("perplexity").isNotNull())
    bins = bins.groupBy(*by, F.floor(F.log("perplexity") / BIN).alias("bin")).agg(*sums)
    to_here = Window.partitionBy(*by).orderBy("bin")  # a row a bin: bounded by the range of log-probabilities
    bins = bins.withColumns({"t": F.sum("trusted").over(to_here), "r": F.sum("rejected").over(to_here)})
    found = bins.groupBy(*by).agg(F.sum("trusted").alias("T"), F.sum("rejected").alias("R"), F.collect_list(F.struct("bin", "t", "r")).alias("bins"))
    gain = lambda x: F.struct((F.col("T") * (F.col("R") - x["r"]) - F.lit(COST) * F.col("R") * (F.col("T") - x["t"])).alias("gain"), x["bin"].alias("bin"))
    best = F.array_max(F.transform("bins", gain))
    enough = (F.col("T") >= SIDE) & (F.col("R") >= SIDE) & (best["gain"] > 0)
    return found.select(*by, F.when(enough, F.exp((best["bin"] + 1) * BIN)).alias("cut"))


def _by_language(scored: DataFrame, own: DataFrame, sent: int) -> DataFrame:
    """Joins own (a row a language) to scored by _lang."""
    if own.count() <= sent:
        return scored.join(F.broadcast(own), "_lang", "left")
    own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a language with most rows is dealt over parts
    scored = scored.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "ll"), F.lit(SALTS)).cast("int"))
    return scored.join(own, ["_lang", "_salt"], "left").drop("_salt")


def _thresholded(scored: DataFrame, quantile: float, sent: int = SENT_LANGS) -> DataFrame:
    scratch = Scratch(scored.sparkSession)
    scored = scored.withColumns({c: F.lit(x) for c, x in (("rejected", False), ("unseen", 0)) if c not in scored.columns})
    some = F.col("size") > 0
    scored = scored.withColumns({"perplexity": F.when(some, F.exp(-F.col("ll") / F.col("size"))), "unseen": F.when(some, F.col("unseen") / F.col("size"))})
    scored = scored.withColumn("_lang", F.coalesce("lang", F.lit("")))
    at = lambda which, column, q: F.percentile_approx(F.when(which, F.col(column)), q, 10_000)
    many = F.count(F.when(calibrates(), 1)) >= LOW
    top = F.coalesce(at(calibrates(), "perplexity", quantile), at(F.lit(True), "perplexity", quantile))
    sums = [top.alias("top"), F.when(many, at(calibrates(), "perplexity", 1 - quantile)).alias("low"), F.when(many, at(calibrates(), "unseen", quantile)).alias("odd")]
    trusted = scored.where("trusted and perplexity is not null")
    own, every = scratch.table(trusted.groupBy("_lang").agg(*sums)), trusted.agg(*sums).first()
    limit = lambda column, whole: F.coalesce(column, F.lit(whole).cast("double"))
    scored = _by_language(scored, own.select("_lang", "low", "odd"), sent)
    scored = scored.withColumns({"low": limit("low", every["low"]), "odd": limit("odd", every["odd"])})
    usual = F.col("odd").isNull() | (F.col("unseen") <= F.col("odd"))
    cuts = scratch.table(own.select("_lang", "top").join(_two_sided(scored.where(usual), ["_lang"]), "_lang", "left").select("_lang", F.coalesce("cut", "top").alias("threshold")))
    parted = _two_sided(scored.where(usual), []).first()
    out = _by_language(scored, cuts, sent).withColumn("threshold", limit("threshold", parted["cut"] if parted and parted["cut"] is not None else every["top"]))
    fits = F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))
    keep = F.col("perplexity").isNotNull() & fits & usual & (F.col("low").isNull() | (F.col("perplexity") >= F.col("low")))
    return out.select("doc_id", "lang", "perplexity", "threshold", "unseen", F.col("odd").alias("unseen_threshold"), keep.alias("keep"))
