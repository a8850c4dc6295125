"""Lists of (id, amount) as bytes: runs of equal amounts, and inside a run the steps from id to id in as few bytes as they need."""

from __future__ import annotations

import numpy as np

#: Bits of a run's kind: ids or amounts that are null.
NO_ID, NO_AMOUNT = 1, 2


def zigzag(v: np.ndarray) -> np.ndarray:
    """Whole numbers of either sign as numbers from 0, small ones as small ones."""
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unzigzag(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64)


def written(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all numbers, seven bits in each, and how many each number takes."""
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1) << np.uint64(7 * k)
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        here = np.flatnonzero(size > k)
        part = (v[here] >> np.uint64(7 * k)) & np.uint64(127)
        out[start[here] + k] = part | np.where(size[here] > k + 1, np.uint64(128), np.uint64(0))
    return out, size


def read(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and the place of the last byte of each."""
    end = np.flatnonzero(data < 128)
    start = np.append(0, end[:-1] + 1)[: len(end)]
    size = end - start + 1
    out = np.zeros(len(end), np.uint64)
    for k in range(int(size.max(initial=0))):
        here = slice(None) if k == 0 else np.flatnonzero(size > k)
        out[here] |= (data[start[here] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out, end


def ranges(size: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, one after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def packed(row: np.ndarray, ids: np.ndarray, no_id: np.ndarray, amounts: np.ndarray, no_amount: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the entries of all rows, and the offsets of the rows in them; entries may come in any order.

    A row is its number of runs, for each run its kind, amount and length, and then the ids.
    """
    kind = no_id * NO_ID + no_amount * NO_AMOUNT
    ids, amounts = np.where(no_id, 0, ids), np.where(no_amount, 0, amounts)
    order = np.lexsort((ids, amounts, kind, row))
    row, ids, kind, amounts = row[order], ids[order], kind[order], amounts[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (kind[1:] != kind[:-1]) | (amounts[1:] != amounts[:-1])
    at = np.flatnonzero(first)
    step = ids.copy()
    step[1:] -= np.where(first[1:], 0, ids[:-1])
    runs, entries = np.bincount(row[at], minlength=rows), np.bincount(row, minlength=rows)
    total = 1 + 3 * runs + entries
    begin = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint64)
    out[begin] = runs
    head = np.repeat(begin + 1, runs) + 3 * ranges(runs)
    out[head], out[head + 1] = kind[at], zigzag(amounts[at])
    out[head + 2] = np.diff(np.append(at, len(row)))
    out[np.repeat(begin + 1 + 3 * runs, entries) + ranges(entries)] = zigzag(step)
    data, size = written(out)
    return data, np.append(0, np.cumsum(size))[np.append(begin, len(out))]


def unpacked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, id is null, amount, amount is null) of every entry; an empty row has none."""
    v, end = read(data)
    begin, stop = np.searchsorted(end, offsets[:-1]), np.searchsorted(end, offsets[1:])
    there = np.flatnonzero(stop > begin)
    begin, stop = begin[there], stop[there]
    runs = v[begin].astype(np.int64)
    head = np.repeat(begin + 1, runs) + 3 * ranges(runs)
    kind, amount, length = v[head].astype(np.int8), unzigzag(v[head + 1]), v[head + 2].astype(np.int64)
    entries = stop - begin - 1 - 3 * runs
    ids = unzigzag(v[np.repeat(begin + 1 + 3 * runs, entries) + ranges(entries)])
    # Steps add up inside a run: the sum over all, less what stood before the run.
    total = np.cumsum(ids)
    at = np.cumsum(length) - length
    ids = total - np.repeat(total[at] - ids[at], length)
    kind = np.repeat(kind, length)
    return np.repeat(there, entries), ids, (kind & NO_ID) > 0, np.repeat(amount, length), (kind & NO_AMOUNT) > 0
