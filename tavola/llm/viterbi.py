"""Token counts of a unigram vocabulary by a Viterbi pass that carries only counts.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each position.
The dynamic programme keeps two numbers per position, the best score and the number of
pieces of the path that has it, and no path. Ties follow the tokenizer: a later match
replaces an earlier one only with a strictly better score, starts being tried from left
to right, so the earliest start (the longest piece) wins.

A character without a piece of its own scores the least vocabulary score minus 10. It
counts as its bytes when the vocabulary falls back to bytes, else a run of such
characters counts as one piece. Scores are added in double precision.

The vocabulary file is a parameter. A file of the BPE kind stores scores as well (minus
the rank of each piece); they are read here as unigram scores, as the tokenizers library's
Unigram model does when it is given the same pieces.

Defined results: a null or empty text has 0 tokens; a text of any length is counted
whole. Columns named like the result are replaced; all other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Added to the least score for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Distinct runs whose counts a Python worker keeps, and the longest of them.
RUNS_KEPT = 500_000
KEPT_LENGTH = 64
_LOWEST = float("-inf")


class UnigramCounter:
    """Counts pieces for (piece, score) pairs."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        self.byte_fallback = byte_fallback
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        # If marks only stand in front of pieces, no piece crosses the start of a run of marks.
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", piece) for piece, _ in pieces)
        self.kept: dict[str, int] = {}

    def run(self, text: str) -> int:
        """Pieces of the best path over `text`."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        best = [0.0] + [_LOWEST] * n
        count = [0] * (n + 1)
        gap = [False] * (n + 1)
        for end in range(1, n + 1):
            top, pieces, alone, unknown = _LOWEST, 0, False, False
            for length, score in sorted(ends[end - 1], reverse=True):
                alone |= length == 1
                if (s := best[end - length] + score) > top:
                    top, pieces, unknown = s, count[end - length] + 1, False
            if not alone and (s := best[end - 1] + self.unknown) > top:
                top, unknown = s, True
                if self.byte_fallback:
                    pieces = count[end - 1] + len(text[end - 1].encode())
                else:
                    pieces = count[end - 1] + (not gap[end - 1])
            best[end], count[end], gap[end] = top, pieces, unknown
        return count[n]

    def count(self, text: str | None) -> int:
        """Tokens of a text: spaces become marks and one mark is put in front."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.splits:
            return self.run(marked)
        total, kept = 0, self.kept
        for run in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked):
            found = kept.get(run)
            if found is None:
                found = self.run(run)
                if len(run) <= KEPT_LENGTH:
                    if len(kept) >= RUNS_KEPT:
                        kept.clear()
                    kept[run] = found
            total += found
        return total


def pieces_of(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces that can match text, with scores, and whether the file falls back to bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = (model.is_control, model.is_unknown, model.is_byte)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not any(f(i) for f in special)]
    return pieces, any(map(model.is_byte, ids))


_LOADED: dict[int, UnigramCounter] = {}


def count_tokens(df: DataFrame, path: str, text: str = "text", result: str = "n_tokens") -> DataFrame:
    """`df` with the number of tokens of its text column under the vocabulary at `path`.

    The vocabulary is read once and sent to the executors; its size is that of a
    vocabulary file, whatever the number of rows.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(pieces_of(path))
    key = hash(path)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _LOADED.get(key)
        if counter is None:
            counter = _LOADED[key] = UnigramCounter(*vocabulary.value)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return df.withColumn(result, count.asNondeterministic()(F.col(text)))
