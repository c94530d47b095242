"""Token files: whole texts as token ids, in ascending id order, Simple-8b coded.

Texts are range-partitioned and sorted by id, encoded where they then are, and written
as blocks. A block has the ids of its texts, how many tokens each has, the word offset
where each begins and one string of 64-bit words; a text begins on a word of its own, so
a block is decoded by vectorised steps over all its words. Blocks are rows of a Parquet
table, so Spark's committer publishes them and a lost task is done anew.

The place of a text among all tokens is the sum of what stands before: of the parts
before (one number for each), of the blocks before in its part, and in its block.

Defined cases: null and empty texts have the end id alone; a null id comes first; equal
ids follow one another in the order of a hash of their texts, in one part or in several;
an empty table gives an empty result; extra columns, whatever their names, are ignored. A very long text is a block of its own.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from desense.llm import byte_words, simple8b
from desense.llm.common import text_bytes, text_slices

BLOCK_TOKENS = 32_768
#: What a worker remembers: so many words at most, with their ids.
KNOWN_WORDS = 1_000_000

BLOCKS = (
    "part int, block int, before long, doc_ids array<long>, counts array<int>, offsets array<int>, words binary"
)


#: Words that a task remembers which counts tokens only, and bytes of text it turns at a time.
COUNTED_WORDS, COUNTED_BYTES = 500_000, 1 << 20


class ByteEncoder:
    """Ids of texts by the tokenizers library, which encodes each distinct word once.

    Words are known by 64-bit hashes of their bytes: among ``KNOWN_WORDS`` words two have
    one hash with a chance of about 3e-8. Texts with characters that ``byte_words`` leaves
    out, or with what may be a special token, go to the library whole.
    """

    def __init__(self, file_text: str, known_words: int = KNOWN_WORDS):
        self.known_words = known_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file_text)
        self.library.no_truncation()
        self.library.no_padding()
        self._forget()

    def _forget(self) -> None:
        self.number_of: dict[int, int] = {}
        self.ends = np.zeros(1, np.int64)  # where the ids of each word end
        self.ids = np.zeros(0, np.uint32)

    def _library_ids(self, texts: list[str]) -> list[array]:
        return [array("I", e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _numbers(self, hashes: np.ndarray, word) -> np.ndarray:
        """Numbers of the words with these (distinct) hashes; ``word(i)`` is the i-th."""
        if len(self.number_of) + len(hashes) > self.known_words:
            self._forget()
        listed, known = hashes.tolist(), self.number_of
        new = [i for i, h in enumerate(listed) if h not in known]
        if new:
            coded = self._library_ids([word(i) for i in new])
            known.update(zip([listed[i] for i in new], range(len(known), len(known) + len(new)), strict=True))
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(coded), np.uint32)])
        return np.fromiter(map(known.__getitem__, listed), np.int64, len(listed))

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that ``byte_words`` can split, and how many each has."""
        raw, offsets = text_bytes(column)
        starts = byte_words.word_starts(raw, offsets)
        ends = np.append(starts[1:], len(raw))
        coded = pa.array(byte_words.word_hashes(raw, starts, ends)).dictionary_encode()
        of, hashes = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        first = np.zeros(len(hashes), np.int64)
        first[of[::-1]] = np.arange(len(of))[::-1]
        at, to, data = starts[first].tolist(), ends[first].tolist(), raw.tobytes()
        number = self._numbers(hashes, lambda i: data[at[i] : to[i]].decode())[of]
        begin, count = self.ends[number], self.ends[number + 1] - self.ends[number]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(starts, offsets)])

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        column = column.cast(pa.large_string()).fill_null("")
        raw, offsets = text_bytes(column)
        special = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        plain = byte_words.plain_texts(raw, offsets) & (np.diff(np.searchsorted(special, offsets)) == 0)
        if plain.all():
            return self._plain(column)
        ids, sizes = self._plain(column.filter(pa.array(plain)))
        own = iter(np.split(ids, np.cumsum(sizes)[:-1])) if len(sizes) else iter(())
        others = iter(self._library_ids(column.filter(pa.array(~plain)).to_pylist()))
        runs = [next(own) if p else np.frombuffer(next(others), np.uint32) for p in plain.tolist()]
        return np.concatenate(runs), np.array([len(r) for r in runs], dtype=np.int64)


def with_ends(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same runs, each with ``end_id`` after its ids."""
    sizes = sizes + 1
    ends = np.cumsum(sizes) - 1
    out = np.full(len(ids) + len(sizes), end_id, np.uint32)
    own = np.ones(len(out), bool)
    own[ends] = False
    out[own] = ids
    return out, sizes


@lru_cache(maxsize=2)
def _encoder(file_text: str) -> ByteEncoder:
    """One encoder in each Python worker, kept from task to task."""
    return ByteEncoder(file_text)


def token_counts(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs`` (doc_id, text), without special tokens; 0
    for null and empty texts. A task's encoder goes with it, so that what a worker does next
    has the memory."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(shared.value, COUNTED_WORDS)
        for batch in text_slices(batches, most=COUNTED_BYTES):
            _, sizes = encoder.batch(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def write_token_files(docs: DataFrame, vocabulary_file: str, path: str, end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the blocks of ``docs`` (doc_id, text) to ``path``, a folder all can reach."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_file)
    schema = pa.schema([
        ("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("words", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(shared.value), TaskContext.get().partitionId()
        block = before = held = 0
        ids, counts, words = [], [], []

        def packed() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            row = [part, block, before, ids, counts, offsets.tolist(), np.concatenate(words).astype("<u8").tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

        for batch in text_slices(batches):
            found, sizes = with_ends(*encoder.batch(batch.column("text")), end_id)
            coded, at = simple8b.encode(found, sizes)
            for i, (doc_id, size) in enumerate(zip(batch.column("doc_id").to_pylist(), sizes.tolist(), strict=True)):
                if held and held + size > block_tokens:
                    yield packed()
                    block, before, held, ids, counts, words = block + 1, before + held, 0, [], [], []
                ids.append(doc_id)
                counts.append(size)
                words.append(coded[at[i] : at[i + 1]])
                held += size
        if ids:
            yield packed()

    # a third key of its own for each row lets rows of one id, even equal ones, lie in several parts
    order = ["doc_id", "_hash", "_row"]
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(run, BLOCKS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every text, from the files alone."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    parts = blocks.groupBy("part").agg(F.sum(size).alias("size"))
    # one row for each part: few, whatever the input
    base = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("before", "base", "doc_ids", "counts", "offsets", "words")}
                counts, offsets = (np.array(row[c].values) for c in ("counts", "offsets"))
                values = simple8b.decode(np.frombuffer(row["words"].as_buffer(), dtype="<u8"), offsets, counts).astype("<u4")
                ends = np.cumsum(counts.astype(np.int64))
                crc = [zlib.crc32(values[a:b]) for a, b in zip(ends - counts, ends, strict=True)]
                start = ends - counts + (row["before"].as_py() + row["base"].as_py())
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(start), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.join(F.broadcast(base), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
