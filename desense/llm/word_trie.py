"""BPE over distinct words: a trie walked depth first, with shared prefixes done once.

In byte-pair merging by rank, the encoding of a prefix is fixed by its last token: the
encoding of what stands before that token, plus the token. A token may follow another
if merging the two tokens' symbols together gives back exactly those two. So the state
of a trie node is its last token; it is found from the states on the path above it, and
all words below reuse it. Sorted words are the depth-first order of their trie, in which
the path above is a stack, so the trie is walked without being held.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

#: The byte-to-character alphabet of byte-level vocabularies: printable bytes stand for
#: themselves, the others follow from code point 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    rest = iter(range(256, 512))
    return [chr(b) if b in _PRINTABLE else chr(next(rest)) for b in range(256)]


class MergeTable:
    """Vocabulary and ranked merges of a BPE file, with an optional word-end suffix.

    A symbol is one character here; a last symbol with the word-end suffix is the
    character ``END`` code points further on, so words and tokens are plain strings.
    """

    END = 0xF0000

    def __init__(self, model: dict):
        self.suffix = model.get("end_of_word_suffix") or ""
        self.alphabet = {b: c for b, c in enumerate(byte_characters()) if chr(b) != c}
        self.ids: dict[str, int] = {self._compact(t): i for t, i in model["vocab"].items()}
        self.names = {self._compact(t): t for t in model["vocab"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(self._compact(a), self._compact(b)): r for r, (a, b) in enumerate(merges)}
        # a token may end a prefix only if its own symbols merge to it; halves: its last merge
        self.halves: dict[str, tuple[str, str] | None] = {}
        for token in self.ids:
            parts, last = self.merge(token)
            if len(parts) == 1:
                self.halves[token] = last
        self.longest = max(map(len, self.halves))
        self.fits: dict[tuple[str, str], bool] = {}
        self.edges: dict[tuple[str, int], list[tuple[str, float]]] = {}

    def forget(self) -> None:
        """Drop what is remembered of pairs of tokens; it can be found again."""
        self.fits, self.edges = {}, {}

    @classmethod
    def from_json(cls, text: str) -> MergeTable:
        return cls(json.loads(text)["model"])

    def _compact(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + self.END)
        return token

    def merge(self, symbols: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging, the best-ranked pair first, of equals the leftmost: the tokens
        and the last pair merged."""
        parts, last, none = list(symbols), None, len(self.rank)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), none))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            last = (parts[best], parts[best + 1])
            parts[best : best + 2] = [last[0] + last[1]]
        return parts, last

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """What stands at one edge of a token while it is merged, from the symbol up,
        each with the rank of the merge that ends it."""
        known = self.edges.get((token, side))
        if known is None:
            known, ends = [], float("inf")
            while True:
                known.append((token, ends))
                if (pair := self.halves[token]) is None:
                    break
                token, ends = pair[side], self.rank[pair]
            known.reverse()
            self.edges[known[-1][0], side] = known
        return known

    def may_follow(self, before: str, token: str) -> bool:
        """Whether no merge across the border comes before the merges on its two sides."""
        pair = (before, token)
        known = self.fits.get(pair)
        if known is None:
            left, right, i, j, known = self._edge(before, 1), self._edge(token, 0), 0, 0, True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                across = self.rank.get((x, y))
                if across is not None and across < x_ends and across <= y_ends:
                    known = False
                    break
                if i == len(left) - 1 and j == len(right) - 1:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            self.fits[pair] = known
        return known

    def word_symbols(self, word: str) -> str:
        """Symbols of a word given as text: its UTF-8 bytes as characters, the last
        one marked as the word's end."""
        chars = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
        return chars[:-1] + chr(ord(chars[-1]) + self.END) if self.suffix and chars else chars

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Tokens of each distinct word (as symbols), by one depth-first walk."""
        path = ""
        last: list[str] = []  # for each depth, the last token of that prefix
        token_of, fits_of, longest = self.halves, self.fits, self.longest
        word_of = {self.word_symbols(w): w for w in words}
        for symbols in sorted(word_of):
            shared = 0
            for a, b in zip(path, symbols, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(symbols) + 1):
                for start in range(max(0, end - longest), end):
                    token = symbols[start:end]
                    if token in token_of:
                        if not start:
                            break
                        fits = fits_of.get((last[start - 1], token))
                        if fits is None:
                            fits = self.may_follow(last[start - 1], token)
                        if fits:
                            break
                else:
                    raise ValueError(f"no token for {symbols[:end]!r}")
                last.append(token)
            path = symbols
            tokens, at = [], len(symbols)
            while at:
                tokens.append(last[at - 1])
                at -= len(last[at - 1])
            yield word_of[symbols], tokens[::-1]
