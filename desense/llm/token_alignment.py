"""Alignment of two tokenizers: which tokens cover the same bytes, and how often they do.

A text with a space before it is encoded by a byte-level BPE (A) and by a sentencepiece
model (B, which adds that space). Where tokens of both end at one byte, a group of tokens
ends; all pairs of an A and a B token of a group are linked.

Neither tokenizer has a token that goes on over a space after a character that is no white
space, so texts are cut there, and each distinct piece is encoded and aligned once a
worker (as long as it remembers no more than ``MOST_PIECES`` of them).

Pairs are counted over the corpus by external spill counting. A task gathers the texts of
a block (bounded text), sorts its (pair, document) records with the A side first, deals
them by radix of the A id to ``PARTS`` parts and writes each as a zstd run to the shared
folder. Runs of a part are merged ``FAN_IN`` at a time, by a heap over the last keys of
their frames, level by level until one is left; as records lie in A order, the largest count
of an A id is known when its pairs end. Then each run meets the counts of its part once
more and gives every document of its block what it adds up to. A pair that stands in all
documents is one entry of each run, so no task gets more of it than of others: counting
moves one entry for a pair and block, and runs are dealt out by part and block.

Defined cases: a text that is null or empty, or that one of the tokenizers does not give
back byte by byte (one with U+2581, which B takes for a space), has zeros and an empty
``groups_sha256``; each row is a document, whatever its id, so repeated rows count each
and null ids are kept; a very long text is a block of its own; an empty table gives an
empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from desense.llm.common import released, text_slices, written

#: Radix parts (a power of two), and bytes of text in a block and turned at a time, about.
PARTS, BLOCK_BYTES, SLICE_BYTES = 16, 4 << 20, 1 << 20
#: Runs that are merged at a time, and entries of a frame.
FAN_IN, FRAME = 64, 1 << 16
#: Runs of a part that meet one copy of its counts.
RUNS_A_TABLE = 64
#: Distinct pieces, and bytes of them, that a worker remembers.
MOST_PIECES, MOST_PIECE_BYTES = 200_000, 32 << 20
#: Links of a group that are written out one by one.
MOST_LINKS = 4096
#: A piece ends after a character that is no white space where a space follows.
PIECE = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+")

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones
    stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and what they make of each distinct piece: a number for it, with
    sizes, the groups as text, and its pairs ``a << 32 | b`` with how often each is linked."""

    def __init__(self, byte_file: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its cores
        self.a = Tokenizer.from_str(byte_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_proto=piece_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.space = pieces.index("▁")
        byte_of = byte_of_char()
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(byte_of.get(c, 63) for c in t) for t in tokens]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        #: A's ids with a comma, with a bar, B's with a comma, with a semicolon
        self.spelled = np.array([f"{i}{end}" for side, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for i in range(len(side))], object)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.bytes = 0
        self.texts: list[str] = []
        self.sizes = np.zeros((0, 5), np.int64)
        self.pairs = self.times = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Number the pieces, which are new and begin with a space: the one that B adds."""
        a_of, b_of = ([x.ids for x in self.a.encode_batch_fast(pieces, add_special_tokens=False)], self.b.encode([p[1:] for p in pieces]))
        b_of = [[self.space] if p == " " else ids for p, ids in zip(pieces, b_of, strict=True)]
        good, raw = np.ones(len(pieces), bool), [p.encode() for p in pieces]
        for side, known in ((a_of, self.a_bytes), (b_of, self.b_bytes)):
            if b"".join(map(known.__getitem__, itertools.chain.from_iterable(side))) != b"".join(raw):
                good &= np.array([b"".join(map(known.__getitem__, ids)) == r for ids, r in zip(side, raw, strict=True)])
        counts = np.array([[len(x) for x in a_of], [len(x) for x in b_of]], np.int64) * good
        a, b = (np.fromiter(itertools.chain.from_iterable(itertools.compress(side, good)), np.int64, n) for side, n in zip((a_of, b_of), counts.sum(1).tolist(), strict=True))
        # tokens of both cover the same bytes, so ends can be compared all over
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        a_cut, b_cut = (np.isin(x, y, assume_unique=True, kind="sort") for x, y in ((a_end, b_end), (b_end, a_end)))
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        left, right = np.bincount(a_group), np.bincount(b_group)
        a_piece = np.repeat(np.arange(len(pieces)), counts[0])
        group_piece = a_piece[a_cut]
        many = left * right
        piece, pair, times = _linked(a, b, a_piece, a_group, left, right)
        sizes = [*counts, np.bincount(group_piece, minlength=len(pieces)), np.bincount(group_piece, many, len(pieces)).astype(np.int64), good]
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        n = len(self.a_bytes)
        spelled = self.spelled[np.concatenate([a + n * a_cut, b + 2 * n + len(self.b_bytes) * b_cut])[order]].tolist()
        ends = np.cumsum(counts.sum(0)).tolist()
        self.texts += ["".join(spelled[lo:hi]) for lo, hi in zip([0, *ends], ends)]
        self.number.update(zip(pieces, range(len(self.sizes), len(self.sizes) + len(pieces)), strict=True))
        self.bytes += sum(map(len, raw))
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64).T])
        self.starts = np.concatenate([self.starts, len(self.pairs) + np.cumsum(np.bincount(piece, minlength=len(pieces)))])
        self.pairs, self.times = np.concatenate([self.pairs, pair]), np.concatenate([self.times, times])

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """n_a, n_b, n_groups and n_links of each text, its digest, and its links as arrays
        (pair, number of the text, how often), texts in order."""
        if len(self.number) > MOST_PIECES or self.bytes > MOST_PIECE_BYTES:
            self.forget()
        cut = [PIECE.findall(" " + t) if t else [] for t in texts]
        if new := list(dict.fromkeys(p for pieces in cut for p in pieces if p not in self.number)):
            self.learn(new)
        number, sizes = self.number, self.sizes
        held = [np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces)) for pieces in cut]
        sums, digests, kept = np.zeros((len(texts), 4), np.int64), [], []
        for i, pieces in enumerate(held):
            good = len(pieces) > 0 and sizes[pieces, 4].all()
            if good:
                sums[i] = sizes[pieces, :4].sum(0)
            digests.append(hashlib.sha256("".join(map(self.texts.__getitem__, pieces.tolist()))[:-1].encode()).hexdigest() if good else "")
            kept.append(pieces if good else pieces[:0])
        of = np.repeat(np.arange(len(texts)), [len(p) for p in kept])
        both, times = np.unique(of * max(len(sizes), 1) + np.concatenate([np.zeros(0, np.int64), *kept]), return_counts=True)
        of, piece = np.divmod(both, max(len(sizes), 1))
        many = self.starts[piece + 1] - self.starts[piece]
        at = _ragged(self.starts[piece], many)
        return sums, digests, (self.pairs[at], np.repeat(of, many), self.times[at] * np.repeat(times, many))


def _ragged(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each start so many numbers from it on."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - starts, many)


def _linked(a: np.ndarray, b: np.ndarray, a_piece: np.ndarray, a_group: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, pair, how often) of the links of all groups, pieces in order. Groups with many
    links give each distinct pair once, others as often as it stands there."""
    starts = np.cumsum(right) - right
    big = left * right > MOST_LINKS
    many = np.where(big, 0, right)[a_group]
    piece, pair = np.repeat(a_piece, many), np.repeat(a, many) << 32 | b[_ragged(starts[a_group], many)]
    times = np.ones(len(pair), np.int64)
    for g in np.flatnonzero(big).tolist():
        at = int(np.searchsorted(a_group, g))
        (x, n), (y, m) = (np.unique(ids, return_counts=True) for ids in (a[at : at + left[g]], b[starts[g] : starts[g] + right[g]]))
        own = ((x << 32)[:, None] | y).reshape(-1)
        piece, pair, times = np.concatenate([piece, np.full(len(own), a_piece[at])]), np.concatenate([pair, own]), np.concatenate([times, np.outer(n, m).reshape(-1)])
    if big.any():
        order = np.argsort(piece, kind="stable")
        piece, pair, times = piece[order], pair[order], times[order]
    return piece, pair, times


@lru_cache(maxsize=1)
def _aligner(byte_file: str, piece_model: bytes) -> Aligner:
    return Aligner(byte_file, piece_model)


# --- runs ---------------------------------------------------------------------------------


def side_major(pairs: np.ndarray) -> np.ndarray:
    """Pairs with the part, the lowest bits of the A id, before them: sorted by it, a part
    is one stretch, in which an A id's pairs are one stretch."""
    return pairs | (pairs >> 32 & (PARTS - 1)) << 58


def _shuffled(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unshuffled(raw: bytes, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T).view(kind).reshape(n)


def packed(*columns: np.ndarray) -> bytes:
    """Integer columns of one length, those in order as differences, as zstd frames."""
    frames = []
    for lo in range(0, len(columns[0]), FRAME):
        part = [c[lo : lo + FRAME].astype(np.int64) for c in columns]
        part[0] = np.diff(part[0], prepend=0)
        body = zstandard.compress(b"".join(map(_shuffled, part)), 1)
        frames.append(struct.pack("<III", len(body), len(part[0]), len(part)) + body)
    return b"".join(frames)


def frames_of(raw: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of ``packed``, frame by frame."""
    at = 0
    while at < len(raw):
        size, n, width = struct.unpack_from("<III", raw, at)
        body = zstandard.decompress(raw[at + 12 : at + 12 + size])
        columns = [_unshuffled(body[8 * n * k :], np.int64, n) for k in range(width)]
        yield (np.cumsum(columns[0]), *columns[1:])
        at += 12 + size


def unpacked(raw: bytes, width: int) -> list[np.ndarray]:
    frames = list(frames_of(raw))
    return [np.concatenate([np.zeros(0, np.int64), *(f[k] for f in frames)]) for k in range(width)]


def merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with their summed counts, in order, from runs of sorted keys. A heap
    has the last key of each run's frame: up to the smallest of them nothing else comes."""
    sources = [frames_of(r) for r in runs]
    now: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def advance(i: int) -> None:
        if (frame := next(sources[i], None)) is not None:
            now[i] = frame
            heapq.heappush(heap, (int(frame[0][-1]), i))

    for i in range(len(runs)):
        advance(i)
    while heap:
        bound, keys, counts = heap[0][0], [], []
        for i, (k, c) in now.items():
            upto = int(np.searchsorted(k, bound, side="right"))
            keys.append(k[:upto])
            counts.append(c[:upto])
            now[i] = k[upto:], c[upto:]
        while heap and heap[0][0] == bound:
            i = heapq.heappop(heap)[1]
            del now[i]
            advance(i)
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, at, np.concatenate(counts))
        yield distinct, total


def with_best(stream: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys and counts in side-major order, with 1 where a count is its A id's highest: an
    A id's pairs are held back until the next A id begins."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for keys, counts in stream:
        held = np.concatenate([held[0], keys]), np.concatenate([held[1], counts])
        cut = int(np.searchsorted(held[0] >> 32, held[0][-1] >> 32))
        if cut:
            yield _best(held[0][:cut], held[1][:cut])
        held = held[0][cut:], held[1][cut:]
    if len(held[0]):
        yield _best(*held)


def _best(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    side = keys >> 32
    starts = np.flatnonzero(np.diff(side, prepend=-1))
    most = np.maximum.reduceat(counts, starts)
    return keys, counts, (counts == np.repeat(most, np.diff(starts, append=len(keys)))).astype(np.int64)


# --- Spark --------------------------------------------------------------------------------

RUN = "block long, part int, n_runs long, pairs binary, records binary"


def runs_of_blocks(docs: DataFrame, byte_file: str, piece_model: bytes) -> DataFrame:
    """For each block of texts a row with part -1, whose ``records`` are the documents'
    results so far (an Arrow stream), and a row for each part: ``pairs`` has the distinct
    pairs and in how many documents each is, ``records`` the documents' numbers in the
    block and how often each is linked, pair after pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_file, piece_model)
        first, n_blocks = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
        ids: list = []
        digests: list[str] = []
        sums: list[np.ndarray] = []
        links: list[tuple[np.ndarray, ...]] = []
        size = 0

        def block() -> pa.RecordBatch:
            stats = pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c) for c in np.concatenate(sums).T), pa.array(digests)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, stats.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(stats)
            rows = [(-1, b"", sink.getvalue().to_pybytes())]
            key, doc, times = (np.concatenate(x) for x in zip(*links, strict=True))
            key = side_major(key)
            order = np.argsort(key, kind="stable")  # documents come in order
            key, doc, times = key[order], doc[order], times[order]
            if len(key):
                starts = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
                key, doc, times = key[starts], doc[starts], np.add.reduceat(times, starts)
            ends = np.append(np.searchsorted(key, np.arange(PARTS, dtype=np.int64) << 58), len(key))
            for part in np.flatnonzero(np.diff(ends)).tolist():
                lo, hi = ends[part], ends[part + 1]
                pairs, counts = np.unique(key[lo:hi], return_counts=True)
                rows.append((part, packed(pairs, counts), packed(doc[lo:hi], times[lo:hi])))
            number = first + n_blocks
            return pa.RecordBatch.from_arrays([
                pa.array([number] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([1] * len(rows), pa.int64()),
                pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()),
            ], names=["block", "part", "n_runs", "pairs", "records"])

        for batch in text_slices(batches, most=SLICE_BYTES):
            own_sums, own_digests, (pair, doc, times) = aligner.batch(batch.column("text").to_pylist())
            links.append((pair, doc + len(ids), times))
            ids += batch.column("doc_id").to_pylist()
            digests += own_digests
            sums.append(own_sums)
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield block()
                ids, digests, sums, links, size, n_blocks = [], [], [], [], 0, n_blocks + 1
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RUN)


def _in_groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of sorted batches as (key, rows) of one group after another."""
    rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
    return itertools.groupby(rows, key=lambda r: tuple(r[c] for c in by))


def merged_level(runs: DataFrame, groups: int) -> DataFrame:
    """(part, block, pairs): of the runs of a part one for each of so many groups of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, group), rows in _in_groups(batches, "part", "block"):
            held: list[bytes] = []
            for row in rows:
                held.append(row["pairs"])
                if len(held) == FAN_IN:
                    held = [b"".join(packed(*x) for x in merged(held))]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([group], pa.int64()), pa.array([b"".join(packed(*x) for x in merged(held))], pa.binary())], names=["part", "block", "pairs"])

    dealt = runs.select("part", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("block"), "pairs")
    return dealt.repartition("part", "block").sortWithinPartitions("part", "block").mapInArrow(run, "part int, block long, pairs binary")


def pair_counts(runs: DataFrame, n_blocks: int) -> DataFrame:
    """(part, frame, counts): each part's pairs in order, with how many documents have each
    and 1 where that is the highest of its A id; a written table."""
    level, groups = runs, n_blocks
    while groups > FAN_IN:
        groups = -(-groups // FAN_IN)
        before, level = level, written(merged_level(level, groups))
        if before is not runs:
            released(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in _in_groups(batches, "part"):
            held: list[bytes] = []
            for row in rows:
                held.append(row["pairs"])
                if len(held) == FAN_IN:
                    held = [b"".join(packed(*x) for x in merged(held))]
            for frame, columns in enumerate(with_best(merged(held))):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([frame], pa.int64()), pa.array([packed(*columns)], pa.binary())], names=["part", "frame", "counts"])

    out = written(level.select("part", "pairs").repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, frame long, counts binary"))
    if level is not runs:
        released(level)
    return out


def contributions(runs: DataFrame, counts: DataFrame, n_blocks: int) -> DataFrame:
    """(block, part, sums): n_best and count_sum that a part adds to each document of a block.

    Counts come before the runs of their part; a part's runs are dealt to as many tasks as
    there are ``RUNS_A_TABLE`` blocks, each of which gets the part's counts, at most one for
    each pair of ids of the two vocabularies."""
    copies = max(1, -(-n_blocks // RUNS_A_TABLE))
    none = F.lit(None).cast("binary")
    tables = counts.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"), F.lit(0).alias("kind"), F.col("frame").alias("block"), F.col("counts").alias("pairs"), none.alias("records"))
    dealt = runs.select("part", F.pmod(F.xxhash64("block"), F.lit(copies)).alias("copy"), F.lit(1).alias("kind"), "block", "pairs", "records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, _), rows in _in_groups(batches, "part", "copy"):
            frames, table = [], None
            for row in rows:
                if row["kind"] == 0:
                    frames.append(row["pairs"])
                    continue
                table = unpacked(b"".join(frames), 3) if table is None else table
                pairs, holders = unpacked(row["pairs"], 2)
                at = np.searchsorted(table[0], pairs)
                doc, times = unpacked(row["records"], 2)
                each = np.repeat(at, holders)
                sums = np.zeros((2, int(doc.max()) + 1), np.int64)
                np.add.at(sums[0], doc, times * table[2][each])
                np.add.at(sums[1], doc, times * table[1][each])
                body = zstandard.compress(_shuffled(sums[0]) + _shuffled(sums[1]), 1)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([part], pa.int32()), pa.array([body], pa.binary())], names=["block", "part", "sums"])

    both = tables.unionByName(dealt).repartition("part", "copy").sortWithinPartitions("part", "copy", "kind", "block")
    return both.mapInArrow(run, "block long, part int, sums binary")


def align_tokens(docs: DataFrame, byte_file: str, piece_model: bytes) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row
    of ``docs`` (doc_id, text), for the texts of a vocabulary file and a model file."""
    table = written(runs_of_blocks(docs, byte_file, piece_model))
    stats, runs = table.where("part < 0"), table.where("part >= 0")
    n_blocks = stats.count()
    counts = pair_counts(runs, n_blocks)
    parts = contributions(runs, counts, n_blocks)
    rows = stats.select("block", "part", F.col("records").alias("sums")).unionByName(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _in_groups(batches, "block"):
            known, total = None, None
            for row in block:
                if known is None:
                    known = pa.ipc.open_stream(row["sums"]).read_all().combine_chunks().to_batches()[0]
                    total = np.zeros((2, known.num_rows), np.int64)
                    continue
                body = zstandard.decompress(row["sums"])
                n = len(body) // 16
                total[0, :n] += _unshuffled(body, np.int64, n)
                total[1, :n] += _unshuffled(body[8 * n :], np.int64, n)
            columns = [known.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total[0]), pa.array(total[1]), known.column("groups_sha256")], names=[c.split()[0] for c in RESULT.split(", ")])

    return rows.repartition("block").sortWithinPartitions("block", "part").mapInArrow(run, RESULT)
