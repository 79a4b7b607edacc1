"""Token counts: how many pieces a unigram tokenizer makes of each text, without making them.

Aho-Corasick enumerates all vocabulary matches of a stretch; a Viterbi pass carries, for each end place, the best score
and the piece count of the path that has it. Tie rules are the tokenizer's: starts are taken in ascending order and a
path replaces another only with a strictly greater score, so the earliest start wins; a character that no single piece
covers costs the least score less 10. Such a character counts its UTF-8 bytes (byte fallback), or, without fallback,
a run of them counts one piece.

No piece of the vocabulary holds a blank after a non-blank, so stretches end before blanks and their scores and counts
add up; each distinct stretch is solved once per process (the cache is bounded). Vocabularies without that property
are solved over whole texts.

Defined results: null and empty texts have 0 pieces and score 0; rows that repeat are counted each by itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import map_text

BLANK = "▁"
CACHE = 1_000_000
_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    byte_fallback: bool = True
    dummy_prefix: bool = True


def load_vocabulary(model_file: str) -> Vocabulary:
    """The ordinary pieces of a sentencepiece model, with their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Vocabulary([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], any(sp.is_byte(i) for i in range(sp.get_piece_size())))


class Counter:
    def __init__(self, v: Vocabulary):
        import ahocorasick

        self.v = v
        self.trie = ahocorasick.Automaton()
        for p, s in zip(v.pieces, v.scores, strict=True):
            self.trie.add_word(p, (len(p), s))
        self.trie.make_automaton()
        self.unknown = min(v.scores) - _PENALTY
        self.splits = v.byte_fallback and not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in v.pieces) and not any("\n" in p for p in v.pieces)
        self.cache: dict[str, tuple[int, float]] = {}

    def solve(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a text whose blanks are already marked."""
        n = len(text)
        if not n:
            return 0, 0.0
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (size, score) in self.trie.iter(text):
            matches[end - size + 1].append((size, score))
        best, count, tail = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        fallback, unknown = self.v.byte_fallback, self.unknown
        for i in range(n):
            here = best[i]
            single = False
            for size, score in matches[i]:
                if size == 1:
                    single = True
                j, s = i + size, here + score
                if best[j] is None or s > best[j]:
                    best[j], count[j], tail[j] = s, count[i] + 1, False
            if not single:
                s = here + unknown
                if best[i + 1] is None or s > best[i + 1]:
                    best[i + 1] = s
                    count[i + 1] = count[i] + (len(text[i].encode()) if fallback else not tail[i])
                    tail[i + 1] = True
        return count[n], best[n]

    def _cached(self, key: str) -> tuple[int, float]:
        found = self.cache.get(key)
        if found is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            found = self.cache[key] = self.solve(key)
        return found

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = (BLANK if self.v.dummy_prefix else "") + text.replace(" ", BLANK)
        if not self.splits:
            return self.solve(marked)
        # stretches: a run of blanks with what follows it; a line end, which no piece holds, opens one too
        parts = marked.replace(BLANK, "\0" + BLANK).replace("\n", "\0\n").split("\0") if "\0" not in text else [marked]
        if BLANK in parts or len(parts) == 1:
            parts = re.findall(f"{BLANK}*[^{BLANK}\n]*|\n[^{BLANK}\n]*", marked)
        got = list(map(self.cache.get, parts))
        if None in got:
            got = [g if g is not None else self._cached(p) for g, p in zip(got, parts, strict=True)]
        return sum(g[0] for g in got), sum(g[1] for g in got)


_COUNTERS: dict[int, tuple] = {}


def token_counts(docs: DataFrame, vocabulary: Vocabulary, *, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, n_pieces, score."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file

    def count(col: pa.Array):
        v = sent.value
        if _COUNTERS.get(0, (None,))[0] is not v:
            _COUNTERS[0] = (v, Counter(v))
        got = [_COUNTERS[0][1].count(t) for t in col.to_pylist()]
        return np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], float)

    return map_text(docs, text, {doc_id: doc_id}, [("n_pieces", "bigint"), ("score", "double")], count)
