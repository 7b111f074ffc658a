"""Token ids of whole texts from public tokenizer files, each distinct piece of text encoded once.

Both tokenizers cut a text into pre-tokens before they merge anything, and no pre-token crosses
a place where a non-space character is followed by white space, nor one where an ASCII letter is
followed by ASCII punctuation that no special string holds. So the ids of a text are the ids
of its parts between such places, one after the other, and a part met before need not be
encoded again. The parts themselves always go through the tokenizer library.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from changegrid.llm import text as T

CACHE_PARTS = 500_000
IS_LETTER, IS_PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
IS_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SPACES_BEFORE_BREAK = re.compile(r"\s[ \n]|\A\s")
_PART = re.compile(r"(?<=\S)(?=[ \t-\r])")


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file; any path may be given instead of a known name."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PartEncoder:
    """Encodes batches of texts. `drops_space`: the tokenizer ignores white space (word vocabularies)."""

    def __init__(self, path: str, drops_space: bool, cache_parts: int = CACHE_PARTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.drops_space, self.cache_parts = drops_space, cache_parts
        self.stops = IS_PUNCTUATION.copy()
        for token in self.tokenizer.get_added_tokens_decoder().values():
            self.stops[[*token.content.encode()]] = False  # special strings stay in one part
        # Vocabularies that mark word ends: one text of many words tells where each word's ids end.
        words = self.tokenizer.get_vocab() if drops_space else {}
        self.ends_word = np.zeros(max(words.values(), default=0) + 1, bool)
        self.ends_word[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used, self.kept_ids, self.passing = 0, 0, []

    def _learn(self, parts: list[bytes], words: bool) -> None:
        flat, sizes = self._encode_parts(parts, words)
        at = len(self.known)
        while at + len(parts) > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while self.used + sizes.sum() > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[at : at + len(parts)] = self.used + np.cumsum(sizes) - sizes
        self.size[at : at + len(parts)] = sizes
        self.known.update(zip(parts, range(at, at + len(parts))))
        self.used += len(flat)

    def _learn_all(self, parts: list[bytes]) -> None:
        is_word = [p.isalpha() if p.isascii() else p.decode().isalpha() for p in parts]
        for words in (True, False):
            some = [p for p, w in zip(parts, is_word) if w == words]
            for i in range(0, len(some), 20_000):
                self._learn(some[i : i + 20_000], words)

    def _encode_parts(self, parts: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, ids per part) straight from the library. `words`: all consist of letters,
        of any script, so each is one pre-token or, where lower-casing adds a mark, more."""
        if words and self.ends_word.any():
            texts = [b" ".join(parts[i : i + 500]).decode() for i in range(0, len(parts), 500)]
            flat = self._ids(texts)[0]
            ends = np.flatnonzero(self.ends_word[flat]) + 1
            if len(ends) == len(parts):
                return flat, np.diff(ends, prepend=0)
        return self._ids([p.decode() for p in parts])

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _part_numbers(self, parts: list[bytes]) -> np.ndarray:
        """Cache slots of distinct parts; what is new is encoded."""
        new = [p for p in parts if p not in self.known]
        room = self.cache_parts - len(self.known)
        self.passing = new[max(room, 0) :]
        new = new[: len(new) - len(self.passing)]
        self._learn_all(new)
        self.kept_ids = self.used
        self._learn_all(self.passing)  # a full cache keeps what it has
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text); null counts as empty."""
        data, offsets = T.utf8(column)
        start, end, doc = self._bounds(data, offsets, column)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        codes, _ = pd.factorize(T.span_hashes(data, start, end))
        firsts = np.full(codes.max() + 1, -1, np.int64)
        firsts[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        slots = self._part_numbers(T.take_spans(data, start[firsts], end[firsts]))[codes]
        sizes = self.size[slots].astype(np.int64)
        ids = self.ids[T.ranges(self.first[slots], sizes)]
        for part in self.passing:
            del self.known[part]
        self.used, self.passing = self.kept_ids, []
        per_doc = np.bincount(doc, weights=sizes, minlength=len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate([np.zeros(1, np.int64), np.cumsum(per_doc)])

    def _bounds(self, data, offsets, column):
        """Parts of every text: words, or white space with the word behind it."""
        stops = np.zeros(len(data), bool)
        stops[1:] = IS_LETTER[data[:-1]] & self.stops[data[1:]]
        if self.drops_space:
            start, end, _ = T.word_bounds(data, offsets)
            opens, closes = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
            stops[offsets[:-1][offsets[:-1] < len(data)]] = False
            opens[start], closes[end] = True, True
            opens[:-1] |= stops
            closes[:-1] |= stops
            start, end = np.flatnonzero(opens), np.flatnonzero(closes)
            return start, end, np.searchsorted(offsets, start, "right") - 1
        inside = ~T.IS_SPACE[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = inside[:-1] & ~inside[1:]  # white space after something else
        begins |= stops
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        # Other white space right before a break would join it in one pre-token: such texts stay whole.
        odd = _unicode_space(data)
        if odd.any():
            owner = np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1
            for d in np.unique(owner):
                begins[offsets[d] + 1 : offsets[d + 1]] = False
                raw = data[offsets[d] : offsets[d + 1]].tobytes().decode()
                cuts = np.array([m.start() for m in _PART.finditer(raw)], np.int64)
                if len(cuts):
                    width = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
                    size = 1 + (width > 0x7F) + (width > 0x7FF) + (width > 0xFFFF)
                    begins[offsets[d] + np.concatenate([[0], np.cumsum(size)])[cuts]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        return start, end, np.searchsorted(offsets, start, "right") - 1


def _unicode_space(data: np.ndarray) -> np.ndarray:
    """Bytes that may begin or be white space beyond ASCII: 1C-1F, 85, A0, 1680, 2000-3000."""
    hit = (data >= 0x1C) & (data <= 0x1F)
    two = np.zeros(len(data), bool)
    if len(data) > 1:
        two[:-1] = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        two[:-1] |= (data[:-1] == 0xE1) & (data[1:] == 0x9A)
        two[:-1] |= (data[:-1] == 0xE2) & ((data[1:] == 0x80) | (data[1:] == 0x81))
        two[:-1] |= (data[:-1] == 0xE3) & (data[1:] == 0x80)
    return hit | two


_ENCODERS: dict[tuple[str, bool], PartEncoder] = {}


def encoder(path: str, drops_space: bool) -> PartEncoder:
    """One encoder per Python worker and file, with its cache."""
    key = (path, drops_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = PartEncoder(path, drops_space)
    return _ENCODERS[key]
