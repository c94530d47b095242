"""BPE encoding and decoding of whole texts with a word-splitting vocabulary file.

Texts are split into words as the vocabulary file prescribes; the distinct words of a
batch that are not yet known are encoded together by a trie walk (``word_trie``); a text
is then a list of look-ups. Words repeat so much that this costs little more than the
splitting. Nothing is shuffled, and rows stay where they are read.

What a task remembers is bounded: known words are forgotten once they exceed
``KNOWN_WORDS``. Texts whose characters are all Latin are split by a pattern here; all
others by the tokenizers library's own normaliser and splitter, which define the result.

Defined cases: null and empty texts have no ids and decode to the empty string; strings
of special tokens in a text become those tokens, as in the library; repeated rows stay
repeated; an empty table gives an empty result; a very long text is encoded whole, as one
slice. Extra columns are ignored; columns to keep may have any names but those of the
results, which are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from desense.llm.common import refuse_clashes, text_slices

KNOWN_WORDS = 600_000

#: Texts of these characters only are split by ``LATIN_WORDS``; their classes and lower
#: cases are the same in every Unicode version.
OTHER = re.compile(r"[^\t\n\r\x20-\x7E\xA1-\xAC\xAE-\xFFŒœ–—‘’“”…]")
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿœ", "0-9²³¹¼½¾"
LATIN_WORDS = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+").findall


class WordCodec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, file_text: str):
        from tokenizers import Tokenizer

        from desense.llm.word_trie import MergeTable, byte_characters

        self.library = Tokenizer.from_str(file_text)
        self.library.no_truncation()
        self.library.no_padding()
        self.table = MergeTable.from_json(file_text)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        pattern = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.cut = re.compile(f"({pattern})") if pattern else None
        self.bytes_of = {c: b for b, c in enumerate(byte_characters())}
        self.ids_of: dict[str, str] = {}
        self.text_of: dict[str, str] = {}

    def pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if not OTHER.search(text):
            return LATIN_WORDS(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        alphabet = self.bytes_of
        cut = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes([alphabet[c] for c in piece]).decode("utf-8", "surrogatepass") for piece, _ in cut]

    def words(self, text: str | None) -> list[str]:
        """Words and special tokens of a text, in order."""
        if not text:
            return []
        if self.cut is None or "<|" not in text:
            return self.pieces(text)
        found = []
        for part in self.cut.split(text):
            found.extend([part] if part in self.special else self.pieces(part))
        return found

    def learn(self, texts: list[list[str]]) -> None:
        used = set(chain.from_iterable(texts))
        new = used - self.ids_of.keys()
        if len(self.ids_of) + len(new) > KNOWN_WORDS:
            self.ids_of, self.text_of, new = {}, {}, used
            self.table.forget()
        for w in self.special.keys() & new:
            self.ids_of[w], self.text_of[w] = str(self.special[w]), w
        ids, names = self.table.ids, self.table.names
        for w, tokens in self.table.encode_words(new - self.special.keys()):
            self.ids_of[w] = " ".join([str(ids[t]) for t in tokens])
            # the file has no decoder, so the library joins the tokens' names by blanks
            self.text_of[w] = " ".join([names[t] for t in tokens])

    def batch(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Count of ids, ids as text and decoded text of each text."""
        split = [self.words(t) for t in texts]
        self.learn(split)
        for ws in split:
            ids = " ".join(map(self.ids_of.__getitem__, ws))
            yield (ids.count(" ") + 1 if ids else 0), ids, " ".join(map(self.text_of.__getitem__, ws))


@lru_cache(maxsize=2)
def _codec(file_text: str) -> WordCodec:
    """One codec in each Python worker, kept from task to task."""
    return WordCodec(file_text)


def encode_decode(docs: DataFrame, vocabulary_file: str, keep: list[str]) -> DataFrame:
    """``keep`` columns plus n_tokens, ids_sha256, decoded_sha256.

    ``vocabulary_file`` is the text of a tokenizer file: its size is fixed, and every
    executor gets it with the job, whether or not it can see the driver's disk.
    """
    refuse_clashes(keep, ["n_tokens", "ids_sha256", "decoded_sha256"])
    carried = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{c}` {carried.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in text_slices(batches):
            done = [(n, digest(ids), digest(text)) for n, ids, text in codec.batch(batch.column("text").to_pylist())]
            n, ids, text = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return carried.mapInArrow(run, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string")
