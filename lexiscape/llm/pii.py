"""Personal data in whole texts, with offsets, plain and disguised.

Base spans are plain matches of four kinds (see the patterns). The method adds disguised ones: three
transducers rewrite the text and keep, for each character they write, the span of source characters
it stands for: (1) homoglyphs and widths become ASCII, invisible characters go; (2) "(at)", "[dot]",
" at ", " dot " and the like become @ and .; (3) runs of spelled digits become digits. Identifiers of
the rewritten text are mapped back through the composed spans. An " at " without brackets counts before a domain with
a listed top-level label (country codes and common ones), or whose last dot was spelled out and is followed by any two
letters or more that don't start like a sentence; a plain dot before an English word that is such a label too ("home.no one") is a
full stop if the sentence goes on; after " at " that last dot isn't the word "point" and the domain doesn't
start with an article or the like ("look at the dot and"). A mapped span is added if the
rewriting changed it and no base span holds all of it; base spans always stay.

Offsets count code points, ends are exclusive. Null text is empty and has no spans; a null doc_id is
carried; repeated ids are handled row by row; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscape.llm import text as T

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Runs of digits can't be entered midway after a failed start, which
# the lookbehind states, so that long runs take linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the run of local characters before each @, not before the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL_CHARS:
            s -= 1
        m = _DOMAIN.match(text, at) if s < at else None
        if m:
            yield s, m.end()
        done = m.end() if m else at
        at = text.find("@", max(done, at + 1))


def base(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as listed."""
    out = [(s, e, "email") for s, e in _emails(text)]
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(d := x.lstrip("0")) <= 3 and int(d or 0) <= 255 for x in m.groups())]
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


# Letters of other scripts that look like Latin ones, by target.
_LOOK_ALIKE = {
    "a": "аα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "κк", "l": "ӏ", "m": "м", "n": "ո", "o": "оο", "p": "рρ",
    "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "@": "﹫", ".": "․。·", "-": "‐‑‒–−", "+": "﬩", " ": "    ",
}
_HIDDEN = "​‌‍⁠﻿­"
_NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "oh": 0,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}


def _glyphs() -> dict[int, str]:
    out = {ord(c): k for k, v in _LOOK_ALIKE.items() for c in v}
    for i in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:  # full width; mathematical letters and digits
        c = unicodedata.normalize("NFKC", chr(i))
        if len(c) == 1 and c < "\x7f":
            out[i] = c
    for i in range(0x80, 0x20000):
        if unicodedata.category(chr(i)) == "Nd":
            out[i] = str(unicodedata.decimal(chr(i)))
    return out


_GLYPH = _glyphs()
_ODD = frozenset(map(chr, _GLYPH)) | frozenset(_HIDDEN)
_TOP = "com|org|net|edu|gov|info|io|co|de|fr|es|eu|uk|us|ch|it|nl|example|test|invalid|local"
#: Country codes and other top-level labels that count in any case of letters but a sentence's start.
_MORE_TOP = frozenset(
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ci ck cl cm cn cr cu cv cw cx cy cz dj dk dm do dz ec ee eg er et fi fj fk fm fo ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in iq ir is je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw "
    "dev app biz mil mobi name pro xyz online site shop tech cloud blog email web int museum jobs travel aero coop asia cat club live news world page link agency media studio digital".split()
)
_NO_DOMAIN = frozenset("the a an this that these those each every any some no one it its his her my your our their which what all both".split())
#: Top-level labels that start English sentences as words.
_TOP_WORDS = frozenset("am as at be by do in is it me my no so to us".split())
_OPEN, _SHUT = r"[\(\[\{<]", r"[\)\]\}>]"
_AT = re.compile(rf"(?i)(?<=[a-z0-9._%+-])\x20*{_OPEN}\x20*(?:at|@|ät|arroba|arobase)\x20*{_SHUT}\x20*(?=[a-z0-9-])|(?<=[a-z0-9._%+-])\x20+(at|arroba|arobase)\x20+(?=([a-z0-9-]++(?:\.[a-z0-9-]++)+))")
_DOT = re.compile(rf"(?i)(?<=[a-z0-9])\x20*{_OPEN}\x20*(?:dot|\.|punkt|punto|point)\x20*{_SHUT}\x20*(?=[a-z0-9])|(?<=[a-z0-9])\x20+(?:dot|punkt|punto|point)\x20+(?=[a-z0-9])")
_SPACED = re.compile(r"(?<=[A-Za-z0-9])\x20+@\x20*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@\x20+(?=[A-Za-z0-9])")
_WORDS = "|".join(sorted(_NUMBERS, key=lambda w: (-len(w), w)))
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:plus\x20)?(?:{_WORDS})(?:[\x20,.()+-]+(?:{_WORDS}|dot|[0-9])(?![^\W\d_])){{2,}}")
_TWO = re.compile(rf"(?:{_WORDS})[\x20,.()+-]+(?:{_WORDS}|dot|[0-9])")
_ONE = re.compile(rf"(?i)(?:(?<![^\W_])({_WORDS})(?![^\W_]))|\x20*,\x20*|(plus)\x20|\x20*\b(dot)\b\x20*|(?<=[a-z])\x20+(?=[a-z])|(?<=[a-z])[-](?=[a-z])")
_MAY_DISGUISE = re.compile(rf"{_OPEN}\x20*(?:at|@|ät|arroba|arobase|dot|\.|punkt|punto|point)\x20*{_SHUT}|\x20(?:dot|punkt|punto|point)\x20|\x20@|@\x20|\x20(?:at|arroba|arobase)\x20+[a-z0-9-]++(?:\.[a-z0-9-]|\x20*{_OPEN})")


class Tape:
    """A rewritten text and, for each of its characters, the bounds of the source it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces spans of the present text, in order; every character written stands for its whole span."""
        if not edits:
            return
        text, starts, ends, changed, at = [], [], [], [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            starts += self.starts[at:s] + [self.starts[s]] * len(new)
            ends += self.ends[at:s] + [self.ends[e - 1]] * len(new)
            changed += self.changed[at:s] + [True] * len(new)
            at = e
        text.append(self.text[at:])
        self.text, self.starts, self.ends, self.changed = "".join(text), starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    out = []
    for run in _SPELLED.finditer(text):
        for m in _ONE.finditer(text, run.start(), run.end()):
            new = str(_NUMBERS[m[1].lower()]) if m[1] else "+" if m[2] else "." if m[3] else "" if m[0].strip(" -") == "" else " "
            out.append((m.start(), m.end(), new))
    return out


def _address(tape: Tape, source: str, m: re.Match) -> bool:
    """Whether an " at " stands before a domain (dots are rewritten by then); a bracketed one always does."""
    if not m[2]:
        return True
    labels = m[2].split(".")
    end = m.end(2)
    plain = not any(tape.changed[i] for i in range(m.start(2), end) if tape.text[i] == ".")
    if m[1].lower() == "at" and plain and labels[-1].lower() in _TOP_WORDS and re.match(r"\x20+[a-z]", tape.text[end : end + 80]):
        return False  # a full stop without a blank behind it
    if any(re.fullmatch(_TOP, x.split("-")[0].lower()) for x in labels[1:]):
        return True
    last, dot = labels[-1], m.end(2) - len(labels[-1]) - 1
    if len(last) < 2 or not last.isalpha() or not (last.islower() or last.isupper()):
        return False
    if not tape.changed[dot]:
        return last.lower() in _MORE_TOP
    english = m[1].lower() == "at"
    word = source[tape.starts[dot] : tape.ends[dot]].lower()
    return not (english and (labels[0].lower() in _NO_DOMAIN or "point" in word))


def disguised(text: str, plain: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Added spans."""
    lower = text.lower()
    odd, maybe, spelled = not text.isascii() and not _ODD.isdisjoint(text), _MAY_DISGUISE.search(lower), _TWO.search(lower)
    if not (odd or maybe or spelled):
        return []
    tape = Tape(text)
    tape.rewrite([(i, i + 1, _GLYPH.get(ord(c), "")) for i, c in enumerate(text) if c in _ODD] if odd else [])
    if odd or maybe:
        for pattern, new in ((_DOT, "."), (_AT, "@"), (_SPACED, "@")):
            tape.rewrite([(m.start(), m.end(), new) for m in pattern.finditer(tape.text) if pattern is not _AT or _address(tape, text, m)])
    tape.rewrite(_spelled(tape.text))
    if tape.text == text:
        return []
    out, reach = [], np.maximum.accumulate([y for _, y, _ in plain]) if plain else []  # how far base spans up to each one go
    firsts = [x for x, _, _ in plain]
    for s, e, kind in base(tape.text):
        a, b = tape.starts[s], tape.ends[e - 1]
        gone = b - a != e - s  # characters that were dropped inside
        before = bisect.bisect_right(firsts, a)
        held = before and reach[before - 1] >= b
        if (gone or any(tape.changed[s:e])) and not held and (kind != "email" or _likely(tape.text[s:e])):
            out.append((a, b, kind))
    return out


def _likely(email: str) -> bool:
    """Rewritten prose must end in letters after the last dot and start with a letter or digit."""
    return bool(re.search(r"\.[A-Za-z]{2,}$", email)) and email[0].isalnum()


def spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans."""
    plain = base(text or "")
    return plain, sorted(plain + disguised(text or "", plain), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all spans), per row."""
    T.bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            counts, digest, every = [], [], []
            for x in b.column("text").to_pylist():
                plain, found = spans(x)
                counts.append([sum(k == y for *_, y in plain) for k in KINDS])
                digest.append(hashlib.sha256(joined(plain).encode()).hexdigest())
                every.append(joined(found))
            cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.record_batch([b.column("doc_id"), *cols, pa.array(digest, pa.string()), pa.array(every, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return T.id_text(docs).mapInArrow(each, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str | None) -> str | None:
    """Every span replaced by its kind; of overlapping spans the first to start names the place."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, kind in spans(text)[1]:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data masked in text (n_chars, where there is one, follows)."""
    T.bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(column):
        return column.map(masked)

    out = docs.withColumn("text", mask(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
