"""Character n-grams of a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, functions as F


def gram_text(text: Column) -> Column:
    """Lower case with runs of whitespace made one blank."""
    return F.regexp_replace(F.lower(text), r"(?U)\s\s+", " ")


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """All character n-grams with `low` to `high` characters, repeated as they occur.

    The lookahead takes the n-gram and the match moves on by one character, which
    walks the text once per length.
    """
    clean = gram_text(text)
    per_length = [
        F.regexp_extract_all(clean, F.lit(rf"(?s)(?=(.{{{n}}})).")) for n in range(low, high + 1)
    ]
    return F.concat(*per_length)


def numbered(texts: list[str], low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, number, n-grams): for each occurrence its text and the place of its n-gram in the list.

    The texts are those of `gram_text`. An n-gram is a number for its first n - 1 characters and one for its
    last, made dense again for each length, so that all texts are cut by a few sorts of numbers.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    joined = "\0".join([*texts, ""])
    letters, letter = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    row = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes) - 1, sizes) - np.arange(len(letter))
    prefix = letter.astype(np.int64)
    rows, numbers, names = [], [], []
    for n in range(2, high + 1):
        at = np.flatnonzero(left >= n)
        found, number = np.unique(prefix[at] * len(letters) + letter[at + n - 1], return_inverse=True)
        prefix[at] = number
        if n >= low:
            place = np.empty(len(found), np.int64)
            place[number] = at
            rows.append(row[at])
            numbers.append(number + len(names))
            names += [joined[p : p + n] for p in place.tolist()]
    return np.concatenate(rows), np.concatenate(numbers), names


def paired(row: np.ndarray, number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, times) of distinct pairs in their order; numbers are below `size`."""
    pair, times = np.unique(row * size + number, return_counts=True)
    return pair // size, pair % size, times


def portions(sizes: Iterable[int], most: int) -> Iterator[slice]:
    """Slices of neighbouring texts with about `most` characters, one text at least."""
    start = held = end = 0
    for size in sizes:
        held, end = held + size, end + 1
        if held >= most:
            yield slice(start, end)
            start, held = end, 0
    if end > start:
        yield slice(start, end)
