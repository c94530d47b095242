"""Words of many texts at once, as a byte-level BPE vocabulary's splitter cuts them.

The splitter takes, from left to right, a contraction (``'s 't 're 've 'm 'll 'd``), a
run of letters, of numbers or of other signs, each with one blank before it if there is
one, or white space; of white space before a word the last character stands alone, and
goes to the word if it is a blank. Here that is said of all bytes of many texts by
vectorised steps. Letters beyond A-Z are those of U+00C0 to U+00FF: texts with other
characters than these and ASCII are left to the caller.
"""

from __future__ import annotations

import numpy as np

_BLANK, _SPACE, _LETTER, _NUMBER, _SIGN, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[[9, 10, 13]] = _SPACE
_CLASS[32] = _BLANK
_CLASS[48:58] = _NUMBER
_CLASS[65:91] = _CLASS[97:123] = _LETTER
#: U+00C0 to U+00FF: this lead byte, then one of 64; two of them are signs.
_LEAD, _NOT_LETTERS = 0xC3, (0x97, 0xB7)
_CLASS[_LEAD] = _CLASS[0x80:0xC0] = _LETTER
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Longer words are hashed by their bytes in one go, not eight at a time.
LONG = 64


def plain_texts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has only characters that ``word_starts`` knows."""
    bad = _CLASS[raw] == _OTHER
    high = np.flatnonzero(raw >= 0x80)
    if len(high):
        # the second byte of a letter must follow the lead, and the lead nothing else
        after = np.concatenate([raw[1:], [0]])[high]
        before = np.concatenate([[0], raw[:-1]])[high]
        lead = raw[high] == _LEAD
        bad[high] |= np.where(lead, np.isin(after, _NOT_LETTERS) | (after < 0x80) | (after >= 0xC0), before != _LEAD)
    return np.diff(np.searchsorted(np.flatnonzero(bad), offsets)) == 0


def word_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of the texts begin, in order; every byte belongs to a word."""
    if not len(raw):
        return np.zeros(0, np.int64)
    kind = _CLASS[raw]
    space = kind <= _SPACE
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    first = np.zeros(len(raw), bool)
    first[begins] = True
    changes = np.empty(len(raw), bool)
    changes[0] = True
    np.not_equal(kind[1:], kind[:-1], out=changes[1:])
    after_blank = np.zeros(len(raw), bool)
    after_blank[1:] = kind[:-1] == _BLANK
    after_blank[begins] = False
    start = (changes & ~space & ~after_blank) | first
    # white space: its first character, and its last one before a word
    start[1:] |= space[1:] & ~space[:-1]
    start[:-1] |= space[:-1] & ~space[1:] & ~first[1:]
    mark = np.flatnonzero((raw == 39) & start)
    if len(mark):
        mark = mark[mark + 1 < len(raw)]
        end = offsets[np.searchsorted(offsets, mark, side="right")]
        byte = lambda k: np.where(mark + k < end, raw[np.minimum(mark + k, len(raw) - 1)], 0)
        one, two = byte(1), byte(2)
        pair = lambda text: (one == ord(text[0])) & (two == ord(text[1]))
        size = np.where(np.isin(one, list(b"stmd")), 1, np.where(pair("re") | pair("ve") | pair("ll"), 2, 0))
        mark, size, end = mark[size > 0], size[size > 0], end[size > 0]
        start[mark + 1] = False
        inside = mark + 1 + size < end
        start[(mark + 1 + size)[inside]] |= ~space[(mark + 1 + size)[inside]]
    return np.flatnonzero(start)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    lengths = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))
    found = (eight[starts] & _MASK[np.minimum(lengths, 8)]) ^ (lengths.astype(np.uint64) * _M[0])
    found = _mixed(found)
    more, at = np.flatnonzero((lengths > 8) & (lengths <= LONG)), 8
    while len(more):
        lane = eight[starts[more] + at] & _MASK[np.minimum(lengths[more] - at, 8)]
        found[more] = _mixed(found[more] * _M[1] + lane)
        at += 8
        more = more[lengths[more] > at]
    for i in np.flatnonzero(lengths > LONG).tolist():
        word = raw[starts[i] : ends[i]]
        whole = np.concatenate([word, np.zeros(-len(word) % 8, np.uint8)]).view("<u8")
        places = _mixed(np.arange(1, len(whole) + 1, dtype=np.uint64) * _M[0])
        found[i] = _mixed(np.array([_mixed(whole ^ places).sum(dtype=np.uint64) + np.uint64(len(word))]))[0]
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(31))) * _M[1]
    x = (x ^ (x >> np.uint64(29))) * _M[2]
    return x ^ (x >> np.uint64(32))
