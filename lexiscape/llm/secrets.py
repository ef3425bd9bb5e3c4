"""Secrets in whole texts, with offsets: plain patterns, and strings that don't compress where secrets are kept.

Base spans are plain matches of three kinds (see the patterns). The method adds spans of kind `novel`. A candidate is a
run of LEAST characters or more of a key's alphabet, with two of lower-case letters, capitals and digits, whose class
changes at MIXED of its places, and that has a sensitive word within NEAR characters before or AFTER behind. Its novelty is what it adds,
a character, to the compressed size of its surroundings (WINDOW characters on either side, without its own repeats) under
zstandard primed with an identifier dictionary, by the dictionary that explains it best. One dictionary is trained on identifiers (snake, camel and other
cases) made of a fixed list of words of code, the other on those made of that list and of the word pieces that most documents of the whole corpus
have. A piece has letters only and no inner change of case, so that a key that thousands of copies share can't enter it. Candidates
of MIN_NOVELTY or more (MIN_LOWER where they are small letters and digits only, which the dictionaries mostly are) are reported, unless one base
span holds them whole; base spans always stay.

Offsets count code points, ends are exclusive. Null text is empty and has no spans; a null doc_id is carried; repeated
rows are handled row by row; texts of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscape.llm import text as T
from lexiscape.session import Scratch

KINDS = ("assign", "access", "hex", "novel")
LEAST, NEAR, AFTER, WINDOW = 16, 64, 32, 400
#: Marginal bytes a character, the same for small letters and digits only; least share of places where the class of character changes.
MIN_NOVELTY, MIN_LOWER, MIXED = 0.88, 0.75, 0.25
#: Word pieces of the corpus that the dictionary is made of, its bytes, the compression level.
PIECES, DICTIONARY_BYTES, LEVEL = 6000, 1 << 16, 19

# The base patterns and their least lengths.
_ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "api")

_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{LEAST},}}")
#: Any sensitive word has one of these.
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "authori", "bearer", "auth", "kennwort", "geheim", "contrase", "clave", "connection", "webhook", "cookie", "session")
_SENSITIVE = re.compile(
    r"pass(?:word|wd|phrase|code|wort)|(?<![a-z])pwd|secret|token|(?:api|access|private|client|account|storage|master|session|shared|license|(?:sign|encrypt)(?:ing|ion)?)[_\x20-]?key"
    r"|credential|authori[sz]ation|bearer|oauth|auth[_:-]|kennwort|geheim|mot\x20de\x20passe|contrase|clave|connection[_\x20-]?string|webhook|cookie|session[_\x20-]?id"
)
# Words of code and of placeholders.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX 0000000000000000 1234567890 1111 deadbeef "
    "abstract account action active address admin alias allow amount api application archive argument array assert async attribute authorization available await backend backup base batch bearer before binary block boolean bound branch bucket buffer build byte cache callback cancel case catch change channel char check child class clear client close cloud cluster code collection column command comment commit common compare complete config configuration confirm connect connection console const constant container content context continue control cookie copy core count create credential current cursor custom data database date datetime debug declare decode default define delete deploy description destination detail device dictionary directory disable display document domain double download driver dynamic element email empty enable encode encrypt endpoint engine entity entry enum environment error event example exception execute exists expire export expression extend external factory false feature field file filter final finally first flag float folder footer force format forward found frame from function gateway generate get global group handle handler hash header height hidden history host html http https icon identifier identity ignore image implement import include index info inherit init initial inline input insert install instance int integer interface internal interval invalid invoke item iterator json key keyboard label lambda language last layout left length level library license limit line link list listener load local location lock log logger login long loop main manager map mapping master match matrix max media member memory menu merge message metadata method min mode model modifier module monitor mount name namespace native network new next node none normal note null number object offset online open operation operator option order origin output override owner package page param parameter parent parse partition password path pattern payload pending permission pixel placeholder platform plugin point policy pool port position post prefix previous primary print priority private process produce product profile program project promise property protected protocol provider proxy public publish query queue random range read record redirect reference region register release remote remove render replace reply report repository request require reset resource response result return right role root route router row rule runtime sample save schema scope script search secret section secure security segment select sender sequence serial server service session set setting setup shared shell signature size socket sort source space split stack stage standard start state static status step storage store stream string struct style submit suffix super support switch symbol sync system table target task template temp temporary test text theme thread throw time timeout timestamp title token tool total trace track transaction transform tree trigger true type undefined unique unit update upload url use user username utility valid validate value variable vector verify version view virtual visible void wait warning web widget width window worker wrapper write www yaml your changeme insert replace here dummy redacted"
)


def base(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as listed."""
    out, lower = [], text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


# Word pieces of four letters or more, whose only capital, if any, is the first letter or all of them.
_PIECE = re.compile(r"[^\W\d_]{4,}")


def pieces(docs: DataFrame, n: int = PIECES) -> list[str]:
    """The n word pieces that the most documents have, of all documents; ties in order of the piece."""
    T.bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            count: Counter[str] = Counter()
            for x in b.column("text").to_pylist():
                if x:
                    count.update(w for w in set(_PIECE.findall(x)) if len(w) <= 24 and (w[1:].islower() or w.isupper()))
            yield pa.record_batch([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["piece", "n"])

    scratch = Scratch(docs.sparkSession)
    found = scratch.table(T.id_text(docs).select("text").mapInArrow(each, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")))
    size = F.floor(8 * F.log2("n")).cast("int")
    left, least = n, 0
    for r in sorted(found.groupBy(size.alias("size")).count().collect(), reverse=True):  # a row an eighth of a doubling
        left, least = left - r["count"], r["size"]
        if left <= 0:
            break
    few = found.where(size >= least).orderBy(F.desc("n"), "piece").limit(n).collect()  # else each task would send n rows
    scratch.drop(found)
    return [r["piece"] for r in few]


def dictionary(own: list[str]) -> bytes:
    """Trained on identifiers of two or three words in eight cases; each word, of the fixed list and of the corpus, begins eight."""
    words, samples = IDENTIFIERS.split() + own, []
    for i, x in enumerate(words):
        y, z = words[(i * 7 + 3) % len(words)], words[(i * 13 + 5) % len(words)]
        samples.append(f"{x}_{y}_{z}\n{x}{y.capitalize()}{z.capitalize()}\n{x} {y} {z}\n{x}.{y}.{z}\n{x}-{y}\n{x.upper()}_{y.upper()}\n{x}={y}\n{x}/{y}/{z}".encode())
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8, level=LEVEL).as_bytes()


class Novelty:
    """Marginal compressed size of strings in their surroundings, under the best of some dictionaries."""

    def __init__(self, *trained: bytes):
        self.zstd = []
        for content in trained:
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.zstd.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False))

    def of(self, around: str, own: str) -> float:
        """Bytes a character that a string adds."""
        before, after = around.encode("utf-8", "replace"), f"{around}\n{own}".encode("utf-8", "replace")
        return min(len(z.compress(after)) - len(z.compress(before)) for z in self.zstd) / len(own)

    def secret(self, around: str, own: str) -> bool:
        return self.of(around, own) >= (MIN_LOWER if own.isalnum() and own == own.lower() else MIN_NOVELTY)


def _mixed(own: str) -> bool:
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in own]
    return len(set(kinds) - {3}) >= 2 and sum(a != b for a, b in zip(kinds, kinds[1:])) >= MIXED * (len(kinds) - 1)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs in sensitive context."""
    lower = text.lower()
    if not any(h in lower for h in _HINTS):
        return
    if len(lower) != len(text):  # some letters have longer lower cases
        lower = "".join(c.lower() if c.isascii() else c for c in text)
    for m in _CANDIDATE.finditer(text):
        s, e = m.start(), m.end()
        while e > s and text[e - 1] in ".=-_":
            e -= 1
        while s < e and text[s] in ".=-_":
            s += 1
        if e - s >= LEAST and _mixed(text[s:e]):
            if _SENSITIVE.search(lower, max(0, s - NEAR), s) or _SENSITIVE.search(lower, e, min(len(lower), e + AFTER)):
                yield s, e


def novel(text: str, plain: list[tuple[int, int, str]], model: Novelty) -> list[tuple[int, int, str]]:
    """Added spans."""
    firsts, reach = [x for x, _, _ in plain], np.maximum.accumulate([y for _, y, _ in plain]) if plain else []
    out = []
    for s, e in candidates(text):
        before = bisect.bisect_right(firsts, s)
        if before and reach[before - 1] >= e:
            continue
        own = text[s:e]
        around = (text[max(0, s - WINDOW) : s] + " " + text[e : e + WINDOW]).replace(own, "")
        if model.secret(around, own):
            out.append((s, e, "novel"))
    return out


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans (all spans), per row."""
    spark = docs.sparkSession
    trained = spark.sparkContext.broadcast((dictionary([]), dictionary(pieces(docs))))  # DICTIONARY_BYTES each
    T.bounded_batches(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in T.slices(batches):
            model = model or Novelty(*trained.value)
            counts, digest, every = [], [], []
            for x in b.column("text").to_pylist():
                plain = base(x or "")
                counts.append([sum(k == y for *_, y in plain) for k in KINDS[:3]])
                digest.append(hashlib.sha256(joined(plain).encode()).hexdigest())
                every.append(joined(sorted(plain + novel(x or "", plain, model), key=lambda x: (x[0], KINDS.index(x[2])))))
            cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.record_batch([b.column("doc_id"), *cols, pa.array(digest, pa.string()), pa.array(every, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS[:3]), "base_sha256", "spans"])

    return T.id_text(docs).mapInArrow(each, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
