"""BPE encoding and decoding with a contiguous array of ranks per word.

A word is a list of part boundaries and, beside it, the rank of every pair of
neighbouring parts. The smallest rank (the leftmost of equals) is searched by a scan,
its boundary is deleted and the two neighbouring ranks are looked up anew. Words over
`SHORT` parts keep the same arrays behind a heap, since a scan for each merge would take
quadratic time. Results equal those of the tokenizers library for the same file.

Defined results: a null or empty text has no ids and decodes to an empty text. A text of
any length is encoded whole. Columns named like the result columns are replaced; all
other columns stay.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.functions.ngrams import portions
from tavola.llm.naming import free

#: Words up to this many parts are merged by scanning, longer ones with a heap.
SHORT = 48
#: Distinct words, with the marks around them, whose ids a Python worker keeps.
WORDS_KEPT = 150_000
#: Characters whose ids and tokens a Python worker holds before it hands them on.
CHARACTERS = 1_000_000
#: Longest of these.
KEPT_LENGTH = 64
#: Control characters that Python takes for white space and the pattern does not.
_CONTROLS = re.compile("[\x1c-\x1f]")

RESULT = "ids binary, n_tokens long"
DECODED = ", decoded string"

_NONE = 1 << 60


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder for a tokenizer file of the word-end BPE kind."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        #: Rank of a pair, and by rank what it is merged to.
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[self.ids[left], self.ids[right]] = rank
            self.merged.append(self.ids[left + right])
        (split, _) = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.special_mark = next(iter(self.special), "<")[:2]
        letters = _byte_letters()
        #: Ids of each byte, inside a word and as its last one.
        self.inside = [self.ids.get(x) for x in letters]
        self.last = [self.ids.get(x + self.suffix) for x in letters]
        #: Ids of runs, and those of the runs before them: what is asked for again moves to the new ones, so
        #: that frequent runs stay when rare ones go.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        """Composed form, runs of white space as one space, lower case letter by letter."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode()
        parts = [self.inside[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def run_ids(self, run: str) -> bytes:
        """Ids of a run without white space, which may hold several words."""
        made = self.older.get(run)
        if made is None:
            out = array("I")
            for word in self.words.findall(run):
                out.extend(self.word_ids(word))
            made = out.tobytes()
        if len(run) <= KEPT_LENGTH:
            if len(self.kept) >= WORDS_KEPT // 2:
                self.older = self.kept.copy()
                self.kept.clear()
            self.kept[run] = made
        return made

    def _scan(self, parts: list[int]) -> list[int]:
        if len(parts) < 2:
            return parts
        rank, merged = self.ranks.get, self.merged
        ranks = [rank(pair, _NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            parts[at] = made = merged[least]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank((made, parts[at + 1]), _NONE)
            if at:
                ranks[at - 1] = rank((parts[at - 1], made), _NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        """The same merges in the same order; `after` and `before` link the parts that are left."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        queue = [(self.ranks[a, b], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in self.ranks]
        heapq.heapify(queue)
        while queue:
            rank, at, a, b = heapq.heappop(queue)
            right = after[at]
            if not alive[at] or right >= n or parts[at] != a or parts[right] != b:
                continue
            parts[at] = self.merged[rank]
            alive[right] = 0
            after[at] = after[right]
            if after[right] < n:
                before[after[right]] = at
            for i in (before[at], at):
                if i >= 0 and after[i] < n and (pair := (parts[i], parts[after[i]])) in self.ranks:
                    heapq.heappush(queue, (self.ranks[pair], i, *pair))
        return [p for p, a in zip(parts, alive) if a]

    def _plain(self, text: str, into: list[bytes]) -> None:
        kept, make = self.kept, self.run_ids
        text = self.normal(text)
        runs = regex.split(r"\s+", text) if _CONTROLS.search(text) else text.split()
        into += [kept.get(r) or make(r) for r in runs if r]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out: list[bytes] = []
        if self.special_re is None or self.special_mark not in text:
            self._plain(text, out)
            return b"".join(out)
        start = 0
        for m in self.special_re.finditer(text):
            self._plain(text[start : m.start()], out)
            out.append(array("I", [self.special[m[0]]]).tobytes())
            start = m.end()
        self._plain(text[start:], out)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces, since the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_LOADED: dict[int, WordBpe] = {}


def loaded(content: str) -> WordBpe:
    """One encoder for each Python process and file."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED[key] = WordBpe(content)
    return _LOADED[key]


def encoded(bpe: WordBpe, batches: Iterable[pd.Series], decoded: bool) -> Iterator[pd.DataFrame]:
    """Rows of the results, handed on for about `CHARACTERS` of text: a batch may be ten thousand long texts."""
    for texts in batches:
        for part in portions((len(t or "") for t in texts), CHARACTERS):
            ids = [bpe.encode(t) for t in texts.iloc[part]]
            made = {"ids": ids, "n_tokens": [len(i) // 4 for i in ids]}
            yield pd.DataFrame(made | ({"decoded": [bpe.decode(i) for i in ids]} if decoded else {}))


def bpe_column(df: DataFrame, text: Column, path: str, decoded: bool = True) -> Column:
    """Struct of `ids` (little-endian unsigned 32-bit integers), `n_tokens` and, if asked for, `decoded`.

    The file at `path` is read here once and sent to the executors; its size is that of
    a vocabulary, whatever the number of rows.
    """
    with open(path, encoding="utf-8") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf(RESULT + DECODED * decoded)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from encoded(loaded(content.value), batches, decoded)

    return encode.asNondeterministic()(text)


def bpe_encode(df: DataFrame, path: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """`df` with `ids`, `n_tokens` and, if asked for, `decoded` of its text column."""
    (name,) = free(df, "_bpe")
    made = df.withColumn(name, bpe_column(df, F.col(text), path, decoded))
    results = ["ids", "n_tokens", *["decoded"] * decoded]
    return made.withColumns({c: F.col(name)[c] for c in results}).drop(name)
