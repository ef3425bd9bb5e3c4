"""Token ids of whole texts, with the tokenizers library behind a bounded cache of words.

The vocabulary's pre-tokenizer never joins what white space parts, and marks at the end of a word
form a piece of their own, if the word ends in a letter or digit once it is normalised. So the ids of a text are those of its words in turn, and a word's ids are
computed once and kept. The cache holds at most CACHE_WORDS words and is emptied when full. New words
of letters go to the library JOINED at a time: each has at least one id that ends a word, so where
there are as many of those as words, they part the ids; other groups are encoded word by word.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS, JOINED = 300_000, 256
#: Text that is encoded at once; a worker's arrays take some 25 times that.
SLICE_BYTES = 4 << 20
#: Fixed value: the only way to part text that the cache of words is right for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII marks that form one pre-token at the end of a word without an apostrophe.
MARKS = ".,!?&%$*#;:"


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of many texts. vocabulary: path of a word-end BPE file whose pre-tokenizer drops white space and lower-cases."""

    def __init__(self, vocabulary: str | None = None, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(vocabulary or default_vocabulary())
        form = json.loads(self.lib.to_str())
        steps = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])]
        splits = [(x["type"], x.get("pattern", {}).get("Regex")) for x in (form["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if form["model"].get("end_of_word_suffix") != "</w>" or steps != ["NFC", "Replace", "Lowercase"] or splits != [("Split", SPLIT), ("ByteLevel", None)]:
            raise ValueError("only a word-end BPE file that lower-cases and splits by SPLIT can be read here")
        self.limit = cache_words
        self.ends = np.zeros(self.lib.get_vocab_size(), bool)
        self.ends[[i for w, i in self.lib.get_vocab().items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.n = np.zeros(1 << 16, np.int32), 0
        self.starts, self.words = np.zeros(1 << 12, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        if self.words + len(words) > self.limit and self.words:
            raise OverflowError
        words, lengths, more = self._coded(words)
        while self.n + len(more) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.words + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.n : self.n + len(more)] = more
        self.starts[self.words + 1 : self.words + len(words) + 1] = self.n + np.cumsum(lengths)
        self.place.update(zip(words, range(self.words, self.words + len(words))))
        self.words += len(words)
        self.n += len(more)

    def _coded(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in another order, the number of ids of each, and all ids."""
        plain, rest, done, lengths, ids = [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for w in words:
            (plain if w.isalpha() else rest).append(w)
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, e in zip(groups, self.lib.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            own = np.array(e.ids, np.int32)
            last = np.flatnonzero(self.ends[own])
            if len(last) == len(group):
                done += group
                lengths.append(np.diff(last, prepend=-1))
                ids.append(own)
            else:
                rest += group
        got = [e.ids for e in self.lib.encode_batch_fast(rest, add_special_tokens=False)]
        lengths.append(np.fromiter(map(len, got), np.int64, len(got)))
        ids.append(np.fromiter(chain.from_iterable(got), np.int32, int(lengths[-1].sum())))
        return done + rest, np.concatenate(lengths), np.concatenate(ids)

    def _unique(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct strings, flat, with starts and lengths."""
        words = _strings(column)
        try:
            if new := [w for w in words if w not in self.place]:
                self._learn(new)
        except OverflowError:
            self._clear()
            self._learn(words)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return self.ids, self.starts[at], self.starts[at + 1] - self.starts[at]

    def _ends_in_letter(self, stem: str) -> bool:
        """Whether marks after a stem are parted from it: not where its last letter is rewritten to a letter and a mark."""
        return unicodedata.category(self.lib.normalizer.normalize_str(stem)[-1:] or " ")[0] in "LN"

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and their n + 1 offsets; null counts as empty."""
        if not len(column):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "").cast(pa.large_string())))
        doc_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten()
        coded = words.dictionary_encode()
        code, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_string())
        stems = pc.ascii_rtrim(distinct, characters=MARKS)
        cut = pc.and_(pc.not_equal(pc.binary_length(stems), pc.binary_length(distinct)), pc.match_substring_regex(stems, r"[\p{L}\p{N}]$"))
        cut = pc.and_(cut, pc.invert(pc.match_substring(distinct, "'"))).to_numpy(zero_copy_only=False).copy()
        odd = np.flatnonzero(cut & ~pc.match_substring_regex(stems, "[0-9A-Za-z]$").to_numpy(zero_copy_only=False))
        cut[odd] = [self._ends_in_letter(x) for x in _strings(stems.take(pa.array(odd)))]
        where = np.flatnonzero(cut)
        tails = [w[len(s) :] for w, s in zip(_strings(distinct.take(pa.array(where))), _strings(stems.take(pa.array(where))))]
        tails = pa.array(tails, pa.large_string()).dictionary_encode()
        tail_of = np.full(len(distinct), -1, np.int64)
        tail_of[where] = tails.indices.to_numpy().astype(np.int64) + len(distinct)
        vocabulary = pa.concat_arrays([pc.if_else(pa.array(cut), stems, distinct), tails.dictionary.cast(pa.large_string())])
        tail_code = tail_of[code]
        ids, starts, lengths = self._unique(vocabulary)
        pieces = np.empty(2 * len(words), np.int64)
        pieces[0::2], pieces[1::2] = code, tail_code
        real = pieces >= 0
        piece_len = np.zeros(len(pieces), np.int64)
        piece_len[real] = lengths[pieces[real]]
        kept = pieces[real]
        size = lengths[kept]
        first = np.cumsum(size) - size
        flat = ids[np.arange(int(size.sum())) - np.repeat(first - starts[kept], size)]
        per_word = piece_len[0::2] + piece_len[1::2]
        ends = np.concatenate([[0], np.cumsum(per_word)])
        return flat, ends[np.concatenate([[0], np.cumsum(doc_words)])]


_shared: dict[str | None, Encoder] = {}


def encoder(vocabulary: str | None = None) -> Encoder:
    """One encoder a worker."""
    if vocabulary not in _shared:
        _shared[vocabulary] = Encoder(vocabulary)
    return _shared[vocabulary]


def with_end(flat: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids followed by the end id."""
    n = len(offsets) - 1
    out = np.empty(len(flat) + n, np.uint32)
    stops = offsets[1:] + np.arange(n)
    body = np.ones(len(out), bool)
    body[stops] = False
    out[body], out[stops] = flat, end
    return out, offsets + np.arange(n + 1)
