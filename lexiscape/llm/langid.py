"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed from left to right
into longest phrases that occur in a language's text; the language that needs the fewest phrases a
character wins (ties: the smaller name). The automata are tables of transitions in one array; where a
phrase ends, the table already leads to the state after the first character of the next one and
marks it, so many texts and all languages are walked at once. Texts are parsed in pieces of PIECE
characters, so that a long one has many lanes; every piece of the whole text counts. Every letter of the training
texts is a symbol: transitions of the DENSE most frequent ones are a table, those of all others are hashed.

Training reads, for each language, at most CHARS characters of at most DOCS labelled texts, those of smallest id
hash, among those whose crc32(doc_id as text) mod 3 is not 1 (documented bounds of the sample). The
automata have at most 2 * CHARS states a language. The score is 1 - phrases of the winner / phrases
of the runner-up (1 with one language), from 0 to 1.

`und`: null text, no letter, or nothing to learn from (score 0). Null lang is never learned. Null
doc_ids hash as the empty text. Very long texts are parsed whole, by pieces. Repeated ids keep their rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscape.llm import text as T

CHARS, DOCS, PIECE, DENSE = 40_000, 100, 1024, 63
#: Text that is parsed at once.
SLICE_BYTES = 2 << 20
UNKNOWN = "und"


def held_out(doc_id="doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def automaton(s: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of the suffix automaton of a sequence of symbols: a table of those under width, -1 where there is none; others as (state, symbol, state)."""
    to, link, length, last = [{}], [-1], [0], 0
    for c in s.tolist():
        cur = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.full((len(to), width), -1, np.int32)
    rare = []
    for i, t in enumerate(to):
        for c, x in t.items():
            if c < width:
                out[i, c] = x
            else:
                rare.append((i, c, x))
    return out, np.array(rare, np.int64).reshape(-1, 3)


class Model:
    """Automata of all languages in one table. Entry: state after the character << 1 | a phrase ended."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        own = {k: "\0".join(v).lower()[:CHARS] for k, v in texts.items()}
        counts = Counter()
        for x in own.values():
            counts.update({c: n / len(x) for c, n in Counter(x).items()})
        known = sorted((c for c in counts if c.isalpha()), key=lambda c: (-counts[c], c))
        known = sorted(known[:DENSE]) + known[DENSE:]
        # 0: a letter of no training text; 1: what is no letter
        self.symbols = np.fromiter((not chr(i).isalpha() for i in range(0x110000)), np.int32, 0x110000)
        self.symbols[[ord(c) for c in known]] = np.arange(2, len(known) + 2)
        self.width = min(len(known), DENSE) + 2
        tables, rare, self.firsts, self.roots, at = [], [np.zeros((0, 3), np.int64)], [], [], 0
        for k in self.languages:
            codes = self.encode(own[k])
            t, more = automaton(codes[self.kept(codes)], self.width)
            rare.append(more + [at, 0, at])
            t[:, 0] = -1
            t = np.concatenate([t, np.full((1, self.width), -1, np.int32)])  # the last state: before a first phrase, or after a character that no phrase holds
            again = np.where(t[0] >= 0, t[0], len(t) - 1)
            table = np.where(t >= 0, (t + at) << 1, ((again + at) << 1 | 1)[None])
            tables.append(table.astype(np.int32))
            self.firsts.append(at)
            self.roots.append(at + len(t) - 1)
            at += len(t)
        if at * self.width >= 1 << 31:
            raise ValueError("too many languages for this many characters each: states are 32-bit numbers")
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        rare = np.concatenate(rare)
        self.rare = T.Lookup(rare[:, 0] << 21 | rare[:, 1], rare[:, 2])

    def encode(self, text: str) -> np.ndarray:
        return self.symbols[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    @staticmethod
    def kept(codes: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
        """All but the repeats in runs of what is no letter; a run never crosses a text's start."""
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1)
        if starts is not None:
            keep[starts[starts < len(codes)]] = True
        return keep

    def follow(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Entries of rarer letters, as in the table: states are rows of languages."""
        key = lambda s: (s.astype(np.int64) << 21 | c).ravel()
        at = self.rare.find(key(state))
        first, last = (np.repeat(np.array(x, np.int64)[:, None], state.shape[1], 1) for x in (self.firsts, self.roots))
        again = self.rare.find(key(first))
        to = self.rare.values[0] if len(self.rare.values[0]) else np.full(1, -1)
        anew = np.where(again >= 0, to[again], last.ravel()) << 1 | 1
        return np.where(at >= 0, to[at] << 1, anew).reshape(state.shape).astype(np.int32)

    def phrases(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each piece (rows) in each language (columns)."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        n, m = len(starts), len(self.roots)
        state = np.repeat(np.array(self.roots, np.int32)[:, None], n, 1)
        count = np.zeros((m, n), np.int32)
        alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right") if n else []
        for step, a in enumerate(alive):
            c = codes[starts[:a] + step]
            got = self.table[state[:, :a] * np.int32(self.width) + np.where(c < self.width, c, 0)]
            odd = np.flatnonzero(c >= self.width)
            if len(odd):
                got[:, odd] = self.follow(state[:, odd], c[odd])
            count[:, :a] += got & 1
            state[:, :a] = got >> 1
        out = np.empty((n, m), np.int64)
        out[order] = count.T
        return out


def train(docs: DataFrame, chars: int = CHARS, sample_docs: int = DOCS) -> Model:
    """A model from a bounded sample of labelled texts of the learning part."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    # row_number() <= k is limited within each task before rows are moved; a language's sample is bounded
    rows = rows.select("lang", F.substring("text", 1, chars).alias("text"), "doc_id").withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_docs)
    texts: dict[str, list[str]] = {}
    for r in rows.orderBy("lang", "k").select("lang", "text").toLocalIterator():
        own = texts.setdefault(r["lang"], [])
        if sum(map(len, own)) < chars:
            own.append(r["text"])
    return Model(texts)


def parse(m: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, score and rate of each text."""
    text, n = pc.fill_null(column, ""), len(column)
    letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
    text = pc.utf8_lower(text)
    size = pc.utf8_length(text).to_numpy().astype(np.int64)
    raw, _ = T.flat(text)
    codes = m.encode(raw.tobytes().decode())
    first = np.cumsum(size) - size
    keep = m.kept(codes, first[size > 0])
    codes, kept = codes[keep], np.concatenate([[0], np.cumsum(keep)])
    size = kept[first + size] - kept[first]
    pieces = np.maximum(-(-size // PIECE), 0)
    doc = np.repeat(np.arange(n), pieces)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
    first = np.cumsum(size) - size
    if not m.languages:
        return np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
    per = m.phrases(codes, first[doc] + at, np.minimum(size[doc] - at, PIECE))
    total = np.zeros((n, len(m.languages)))
    np.add.at(total, doc, per)
    best = total.argmin(axis=1)
    low = total[np.arange(n), best]
    total[np.arange(n), best] = np.inf
    score = np.where(letters, np.clip(1 - low / np.maximum(total.min(axis=1), 1), 0, 1), 0.0)
    return np.where(letters, np.array(m.languages, object)[best], UNKNOWN), score, low / np.maximum(size, 1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rate (phrases a character of the winner)."""
    spark = docs.sparkSession
    T.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in T.slices(batches, limit=SLICE_BYTES):
            name, score, rate = parse(m, b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array(name, pa.string()), pa.array(score), pa.array(rate)], names=["doc_id", "lang_pred", "score", "rate"])

    return T.id_text(docs).mapInArrow(each, "doc_id long, lang_pred string, score double, rate double")


def identify(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rate, for every row."""
    return predict(docs, train(docs, **how)).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "rate")


def known(docs: DataFrame) -> DataFrame:
    """Rows with a language: `und` goes. Each row is judged by its own text, on its way through a task."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs))
    T.bounded_batches(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, limit=SLICE_BYTES):
            yield b.filter(pa.array(parse(shared.value, b.column("text"))[0] != UNKNOWN))

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(each, docs.schema)
