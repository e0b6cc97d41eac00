"""Whole texts to token ids, many texts at a time.

The tokenizer lower-cases, then cuts a text into runs of letters, single digits and runs of
anything else but white space, and codes each piece on its own. The ids of a text are those of its
pieces, one after the other. As no piece goes over white space, each distinct word between white space
goes to the tokenizers library once; a text is then a gather from the ids of its words, which Arrow finds and
numbers. Long words are cut into pieces first. Texts with characters for which Python's classes might differ from the library's
are cut at white space alone, which the library drops too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

END_ID = 1
PIECE = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Contractions, special tokens, digits that aren't decimal, the one Latin letter whose lower case is two characters,
#: and letters beyond Latin.
ODD = re.compile("['\xb2\xb3\xb9\xbc-\xbe\x1c-\x1fİɐ-\U0010ffff]|<\\|")
#: str.split() takes these as white space, the tokenizer does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Longer words are cut into pieces before they are looked up.
LONG_WORD = 48
#: Characters of text that are worked on together.
TOGETHER = 4 << 20


def is_odd(text: str) -> bool:
    """``ODD.search``; for ASCII plain substring tests do."""
    if text.isascii():
        return any(x in text for x in ("'", "<|", "\x1c", "\x1d", "\x1e", "\x1f"))
    return bool(ODD.search(text))


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids as ``tokenizers`` gives them, add_special_tokens=False.

    ``most_pieces`` bounds the cache; it is emptied when full.
    """

    def __init__(self, path: str, most_pieces: int = 700_000):
        self.tokenizer, self.most_pieces = Tokenizer.from_file(path), most_pieces
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.used = np.zeros(1 << 12, np.int64), 0  # start has one place more than there are pieces

    def learn(self, words: list[str], plain: bool = False) -> None:
        """Codes for new words: new pieces of plain ones are joined by blanks and coded as one text."""
        easy = words if plain else [w for w in words if not is_odd(w)]
        mixed = [w for w in easy if not w.isalpha()]
        cut = list(map(PIECE.findall, mixed))
        pieces = {p for p in chain.from_iterable(cut) if p not in self.code}
        pieces.update(filter(str.isalpha, easy))
        if pieces:
            pieces = sorted(pieces)
            coded = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
            counts = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(pieces))
            if len(counts) != len(pieces):  # the library cuts otherwise
                return self._one_by_one(words)
            self._store(pieces, counts, np.array(coded.ids, np.uint32))
        made = [(w, c) for w, c in zip(mixed, cut, strict=True) if len(c) > 1 and w not in self.code]
        if made:
            ids, ends = self._gather(np.fromiter(map(self.code.__getitem__, chain.from_iterable(c for _, c in made)), np.int64))
            self._store([w for w, _ in made], np.diff(ends[np.cumsum([0, *(len(c) for _, c in made)])]), ids)
        if not plain:
            self._one_by_one(words)

    def _one_by_one(self, words: list[str]) -> None:
        rest = [w for w in words if w not in self.code]
        if rest:
            own = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in rest]
            self._store(rest, np.array([len(x) for x in own], np.int64), np.array(list(chain.from_iterable(own)), np.uint32))

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of coded words one after the other, and where each begins."""
        starts = self.start[codes]
        lengths = self.start[codes + 1] - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])], ends

    def _store(self, pieces: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        k = len(self.code)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(pieces) >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k + 1 : k + 1 + len(pieces)] = self.used + np.cumsum(counts)
        self.used += len(ids)
        self.code.update(zip(pieces, range(k, k + len(pieces)), strict=True))

    def pieces(self, text: str) -> list[str]:
        if is_odd(text):
            return [text] if SEPARATORS.search(text) else text.split()
        words = text.lower().split()
        if max(map(len, words), default=0) > LONG_WORD:
            words = list(chain.from_iterable([w] if len(w) <= LONG_WORD else PIECE.findall(w) for w in words))
        return words

    def documents(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each document with the end id; null is empty."""
        at, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size >= TOGETHER or k + 1 == len(texts):
                yield from self._together(texts[at : k + 1])
                at, size = k + 1, 0

    def _codes(self, words: list[str], plain: bool = False) -> np.ndarray:
        """The codes of words, learned if new. ``plain``: distinct words of texts that aren't odd."""
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(codes < 0)):
            missing = [words[i] for i in new.tolist()]
            self.learn(missing if plain else list(dict.fromkeys(missing)), plain)
            codes[new] = np.fromiter(map(self.code.__getitem__, missing), np.int64, len(missing))
        return codes

    def _together(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if len(self.code) > self.most_pieces:
            self.forget()
        plain = [i for i, t in enumerate(texts) if t and not is_odd(t)]
        cut = pc.utf8_split_whitespace(pa.array([texts[i].lower() for i in plain], pa.string()))
        offsets, numbered = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        words, index = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        long = [k for k, w in enumerate(words) if len(w) > LONG_WORD]
        holders = set()
        if long:
            at = np.flatnonzero(np.isin(index, long))
            holders = {plain[k] for k in np.unique(np.searchsorted(offsets, at, side="right") - 1).tolist()}
            for k in long:
                words[k] = ""
        ids, ends = self._gather(self._codes(words, plain=True)[index])
        cuts = dict(zip(plain, zip(ends[offsets[:-1]].tolist(), ends[offsets[1:]].tolist(), strict=True), strict=True))
        for i, text in enumerate(texts):
            if i in cuts and i not in holders:
                own = ids[slice(*cuts[i])]
            else:
                own = self._gather(self._codes(self.pieces(text)))[0] if text else ids[:0]
            yield np.append(own, np.uint32(END_ID))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path)
