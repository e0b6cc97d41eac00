"""Token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton over the vocabulary lists every match of a word; dynamic programming
over end positions carries the best score and the number of pieces behind it. Ties go as in the
tokenizer: at each end the candidates come by ascending start and only a higher score replaces;
a character that is no piece of its own may be unknown, at the lowest score less ten, and
neighbouring unknowns are one piece. Scores are added in the same order, so they round alike.

The text is split at white space and each word begins with the piece marker, so a document's
count is the sum over its words, and each distinct word is worked out once.

Texts are taken whole; a word without end takes no more memory than its longest piece reaches back.
Null, empty and blank texts have no tokens. Extra columns are left out. Repeated rows are
repeated rows of the result; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from talentloom.llm.common import field_sql, map_arrow

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Longer words are worked out each time, not kept.
LONG_WORD = 256
#: str.split() takes these as white space, Unicode doesn't.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[^\\S\x1c-\x1f]+")


def default_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores, and the number of the unknown piece.

    A unigram model's own scores; a vocabulary that has only ranks gets -ln(rank + 2).
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "Unigram":
            raise ValueError(f"{path} is no unigram model")
        return [(p, s) for p, s in model["vocab"]], model["unk_id"]
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = ["<unk>"] + [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [(p, -math.log(rank + 2)) for rank, p in enumerate(pieces)], 0


class Counter:
    """``word(w)`` gives (pieces, unknown pieces, score) of one word with its marker."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int, most_words: int = 200_000):
        self.matches = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(vocabulary):
            self.matches.add_word(piece, (len(piece), score, k == unknown))
        self.matches.make_automaton()
        self.longest = max(len(p) for p, _ in vocabulary)
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.cache: dict[str, tuple[int, int, float]] = {}
        self.most_words = most_words

    def solve(self, word: str) -> tuple[int, int, float]:
        n = len(word)
        size = min(n, self.longest) + 1
        # at each end: score, pieces, unknown pieces, whether the last is unknown; a ring, as matches reach back no further
        best: list = [None] * size
        best[0] = (0.0, 0, 0, False)
        own, at = False, 0
        for end, (length, score, lost) in self.matches.iter(word):
            while at < end:  # ends without a further match
                self._close(best, own, at, size)
                own, at = False, at + 1
            own = own or length == 1
            before = best[(end + 1 - length) % size]
            total = score + before[0]
            place = (end + 1) % size
            if best[place] is None or total > best[place][0]:
                joined = lost and before[3]
                best[place] = (total, before[1] + (not joined), before[2] + (lost and not joined), lost)
        while at < n:
            self._close(best, own, at, size)
            own, at = False, at + 1
        score, pieces, unknown, _ = best[n % size]
        return pieces, unknown, score

    def _close(self, best: list, own: bool, at: int, size: int) -> None:
        """The character at ``at`` as unknown, the last candidate of its end; then the next end's place is free."""
        if not own:
            before, place = best[at % size], (at + 1) % size
            total = self.unknown + before[0]
            if best[place] is None or total > best[place][0]:
                best[place] = (total, before[1] + (not before[3]), before[2] + (not before[3]), True)
        best[(at + 2) % size] = None

    def word(self, word: str) -> tuple[int, int, float]:
        found = self.cache.get(word)
        if found is None:
            found = self.solve(MARK + word)
            if len(word) <= LONG_WORD:
                if len(self.cache) >= self.most_words:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def text(self, text: str | None) -> tuple[int, int, float]:
        if not text:
            return 0, 0, 0.0
        words = [w for w in _SPACE.split(text) if w] if _NOT_SPACE.search(text) else text.split()
        if not words:
            return 0, 0, 0.0
        counts, unknown, scores = zip(*map(self.word, words), strict=True)
        return sum(counts), sum(unknown), math.fsum(scores)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(*read_vocabulary(path))


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_unknown, score (the log-likelihood of the best pieces)."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = counter(path)
        n, unknown, score = zip(*map(own.text, batch.column("text").to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(unknown, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "n_unknown", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, f"{field_sql(docs, 'doc_id')}, n_tokens long, n_unknown long, score double")
