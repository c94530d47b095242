"""Simple-8b word-aligned coding of non-negative integers, with numpy.

A 64-bit word has a selector in its top four bits and a fixed number of values of a
fixed width below. Values over 60 bits follow an escape word as they are. The last word
of a run is filled up with zeros; how many values count is kept outside.
"""

from __future__ import annotations

from array import array

import numpy as np

#: How many values of how many bits each selector packs.
COUNTS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
WIDTHS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
_COUNT_OF = np.array([*COUNTS, 0, 1])


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, over 53 bits one too many at most; small values by a table."""
    most = int(values.max()) if len(values) else 0
    if most < 1 << 20:
        return np.frexp(np.arange(most + 1, dtype=np.float64))[1].astype(np.int8)[values.astype(np.int64)]
    return np.frexp(values.astype(np.float64))[1].astype(np.int8)


def encode(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all runs (``flat`` has their values one after the other, ``sizes`` how many
    each has), and where each run begins (one more at the end). Each word takes as many of
    its run's next values as any selector can."""
    pad, sizes = COUNTS[-1], np.asarray(sizes, dtype=np.int64)
    # runs lie one after the other with zeros between, so no word reaches into the next
    begins = np.concatenate([[0], np.cumsum(sizes + pad)])
    inside = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)) * pad, sizes)
    values = np.zeros(int(begins[-1]), np.uint64)
    values[inside] = flat
    real = np.zeros(len(values), bool)
    real[inside] = True
    bits = _bit_lengths(values)
    widest, span = bits, 1
    selector = np.where(bits > WIDTHS[0], np.int8(ESCAPE), np.int8(0))
    for s in range(1, len(COUNTS)):
        more = COUNTS[s] - span
        widest, span = np.maximum(widest[:-more], widest[more:]), COUNTS[s]
        fits = (widest <= WIDTHS[s]) & real[: len(widest)]
        if not fits.any():
            break
        np.copyto(selector[: len(fits)], np.int8(s), where=fits)
    # from a word's first value to the next word's; past a run's end, to the next run that
    # has a value, or to the end of all
    filled = np.concatenate([begins[:-1][sizes > 0], begins[-1:]])
    after = np.arange(len(values)) + _COUNT_OF[selector]
    last = np.minimum(after, max(len(values) - 1, 0))
    over = np.flatnonzero(~real[last] & real)
    after[over] = filled[np.searchsorted(filled, over, side="right")]
    # the walk from word to word needs each word's step; small numbers are cheap in Python
    step, taken, at, stop = array("I", (after - np.arange(len(values))).astype(np.uint32).tobytes()), array("I"), int(filled[0]), int(begins[-1])
    add = taken.append
    while at < stop:
        k = step[at]
        add(k)
        at += k
    starts = np.cumsum(np.frombuffer(taken, np.uint32), dtype=np.int64)
    starts += int(filled[0]) - np.diff(starts, prepend=0)
    chosen = selector[starts]
    escaped = chosen == ESCAPE
    place = np.arange(len(starts)) + np.cumsum(escaped) - escaped
    total = len(starts) + int(escaped.sum())
    words = np.zeros(total, np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        own = np.flatnonzero(chosen == s)
        first = starts[own]
        if s == ESCAPE:
            words[place[own] + 1] = values[first]
            continue
        packed = values[first]
        for k in range(1, COUNTS[s]):
            packed |= values[first + k] << np.uint64(k * WIDTHS[s])
        words[place[own]] |= packed
    return words, np.concatenate([place, [total]])[np.searchsorted(starts, begins)]


def decode(words: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Values of all runs of a block: run i has the words from offsets[i] on, and
    counts[i] values."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw, before = [], -1
    for at in np.flatnonzero(selector == ESCAPE).tolist():
        if at != before:  # else this is an escaped value itself
            before = at + 1
            raw.append(before)
    raw = np.array(raw, dtype=np.int64)
    size = _COUNT_OF[selector]
    size[raw - 1] = 0
    size[raw] = 1
    selector[raw] = ESCAPE
    ends = np.cumsum(size)
    begins = ends - size
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selector[size > 0]):
        own = np.flatnonzero((selector == s) & (size > 0))
        if s == ESCAPE:
            out[begins[own]] = words[own]
            continue
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s]):
            out[begins[own] + k] = (words[own] >> np.uint64(k * WIDTHS[s])) & mask
    first = np.concatenate([begins, ends[-1:]])[offsets[:-1]] if len(words) else np.zeros(len(counts), np.int64)
    kept = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
    return out[kept]
