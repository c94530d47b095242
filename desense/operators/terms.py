"""A dictionary of any size as a table: a seed index, joined with the texts.

Each term is known by one seed, a run of its bytes: of the runs near its beginning the one
that is rarest in the texts, by counts over all of them. A text gives the places whose
bytes may be a seed, with what stands around them, and an equi-join by seed brings the
terms that may stand there, which are compared byte by byte. Neither texts nor terms go
through the driver; it sees the counts and a filter of the seeds, both of bounded size.

Places of a seed that stands in very many texts are rows of a large join partition, which
Spark splits, as each term is there once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Bytes of a seed, by falling preference; a shorter term is its own seed.
WIDTHS = (8, 4, 3, 2, 1)
#: A seed begins among the first bytes of its term; so many bytes after it begins, and so
#: many before, go with a place.
BEFORE, AFTER = 32, 96
#: Counters of seeds; bits of the filter for each seed, and at most.
COUNTERS, BITS_A_SEED, MOST_BITS = 1 << 16, 16, 1 << 28
#: Bytes of the filter, and counters, in one row while they are summed.
CHUNK = 1 << 16
#: Bytes of text turned at a time.
SLICE = 2 << 20

_SALT = {w: np.uint64(0x9E3779B97F4A7C15 * (2 * w + 1) % (1 << 64)) for w in WIDTHS}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def seeds_of(raw: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from each place on where so many are left."""
    n = max(len(raw) - width + 1, 0)
    value = np.zeros(n, np.uint64)
    for k in range(width):
        value |= raw[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return _mixed(value + _SALT[width])


def width_of(size: int) -> int:
    return next(w for w in WIDTHS if w <= size)


def _places(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each seed."""
    return (seeds & np.uint64(bits - 1)).astype(np.int64), (seeds >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def _text_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about ``SLICE`` bytes of text at a time, with the bytes and where texts begin."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def _inside(offsets: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which places have ``width`` bytes before their text ends."""
    ok = np.ones(max(total - width + 1, 0), bool)
    for k in range(1, width):
        ends = offsets[1:-1] - k
        ok[ends[(ends >= 0) & (ends < len(ok))]] = False
    return ok


def _summed(parts: DataFrame, how: str) -> dict[int, bytes]:
    """Chunks (chunk, body) summed as counters or joined as bits; bounded, so collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(body, np.int64)
                old = total.get(chunk)
                total[chunk] = new.copy() if old is None else (old + new if how == "sum" else old | new)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "body"])

    return {r["chunk"]: bytes(r["body"]) for r in parts.repartition("chunk").mapInArrow(run, "chunk int, body binary").collect()}


def _chunks(values: np.ndarray) -> pa.RecordBatch:
    """The parts of an array of 64-bit words that are not zero."""
    size = CHUNK // 8
    used = [k for k in range(0, len(values), size) if values[k : k + size].any()]
    return pa.RecordBatch.from_arrays([pa.array([k // size for k in used], pa.int32()), pa.array([values[k : k + size].tobytes() for k in used], pa.binary())], names=["chunk", "body"])


def _joined(chunks: dict[int, bytes], words: int) -> np.ndarray:
    out = np.zeros(words, np.int64)
    for k, body in chunks.items():
        out[k * (CHUNK // 8) : k * (CHUNK // 8) + len(body) // 8] = np.frombuffer(body, np.int64)
    return out


def seed_counts(docs: DataFrame, widths: list[int]) -> np.ndarray:
    """How often seeds of each class stand in the texts, all of them; ``COUNTERS`` classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for _, raw, offsets in _text_slices(batches, "text"):
            for w in widths:
                seeds = seeds_of(raw, w)[_inside(offsets, w, len(raw))]
                total += np.bincount((seeds & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        yield _chunks(total)

    return _joined(_summed(docs.select("text").mapInArrow(run, "chunk int, body binary"), "sum"), COUNTERS)


def seeded(terms: DataFrame, counts: np.ndarray) -> DataFrame:
    """``terms`` with the seed of each, at which byte of it the seed begins (offset), how
    many characters begin before that (lead), and the number of its bytes (size)."""
    schema = StructType([*terms.schema.fields, *(StructField(c, LongType()) for c in ("seed", "offset", "lead", "size"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for term in batch.column("term").to_pylist():
                raw = np.frombuffer(term.encode(), np.uint8)
                seeds = seeds_of(raw[: BEFORE + 8], width_of(len(raw)))[: BEFORE + 1]
                at = int(counts[(seeds & np.uint64(COUNTERS - 1)).astype(np.int64)].argmin())
                out.append((int(seeds[at : at + 1].view(np.int64)[0]), at, int((raw[:at] & 0xC0 != 0x80).sum()), len(raw)))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return terms.mapInArrow(run, schema)


def seed_filter(seeds: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the seeds, as bytes."""
    bits = 1 << 13
    while bits < min(n * BITS_A_SEED, MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield _chunks(own.view(np.int64))

    return _joined(_summed(seeds.select("seed").mapInArrow(run, "chunk int, body binary"), "or"), bits // 64).view(np.uint8)


def places(docs: DataFrame, widths: list[int], known: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, seed, at, head, around): the places of the texts that the filter
    lets through, at which character and with how many of the bytes ``around`` before it."""
    spark, bits = docs.sparkSession, len(known) * 8
    shared = spark.sparkContext.broadcast(known.tobytes())
    doc_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(shared.value, np.uint8)
        for batch, raw, offsets in _text_slices(batches, "text"):
            begun = np.cumsum(raw & 0xC0 != 0x80)
            for w in widths:
                seeds = seeds_of(raw, w)
                a, b = _places(seeds, bits)
                hit = (own[a >> 3] >> (a & 7).astype(np.uint8)) & (own[b >> 3] >> (b & 7).astype(np.uint8)) & 1
                at = np.flatnonzero(hit.astype(bool) & _inside(offsets, w, len(raw)))
                row = np.searchsorted(offsets, at, side="right") - 1
                start, end = offsets[row], offsets[row + 1]
                lo, hi = np.maximum(start, at - BEFORE), np.minimum(end, at + AFTER)
                char = begun[at] - (raw[at] & 0xC0 != 0x80) - (begun[start] - 1)
                whole = raw.tobytes()
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(seeds[at].view(np.int64)),
                    pa.array(char.astype(np.int32)), pa.array((at - lo).astype(np.int32)), pa.array([whole[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()),
                ], names=["doc_id", "text_hash", "seed", "at", "head", "around"])

    schema = StructType([StructField("doc_id", doc_type), *StructType.fromDDL("text_hash long, seed long, at int, head int, around binary").fields])
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def _leftmost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted hits of one term in one text those that don't begin inside the last taken."""
    last, end = None, 0
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "entity_type", "detector_order", "value")), strict=True)
        keep = []
        for key, a, b in zip(keys, batch.column("start_at").to_pylist(), batch.column("end_at").to_pylist(), strict=True):
            if key != last:
                last, end = key, 0
            keep.append(a >= end)
            if a >= end:
                end = b
        yield batch.filter(pa.array(keep, pa.bool_()))


def term_hits(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, entity_type, value, start_at, end_at, detector_order) of each place where a
    term of (entity_type, term, detector_order) stands; of overlapping hits of one term the
    leftmost stay. Rows of ``docs`` (doc_id, text) that are equal count once."""
    docs = docs.select("doc_id", "text").where("text <> ''")
    sizes = terms.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("term") > AFTER).alias("long"), *[F.max(F.octet_length("term") >= w if w == 8 else F.octet_length("term").between(w, 7 if w == 4 else w)).alias(f"w{w}") for w in WIDTHS]).first()
    widths = [w for w in WIDTHS if sizes[f"w{w}"]]
    found = seeded(terms, seed_counts(docs, widths)) if widths else terms.select("*", *[F.lit(0).cast("long").alias(c) for c in ("seed", "offset", "lead", "size")])
    known = seed_filter(found, sizes["n"])
    # both sides are shuffled: what a task makes of its rows has no size that Spark could tell
    # beforehand, and a side that it takes for small would go through the driver
    met = places(docs, widths, known).join(found.hint("merge"), "seed")
    # what the bytes at hand can tell
    first = F.col("head") - F.col("offset").cast("int")
    held = F.least(F.col("size").cast("int"), F.octet_length("around") - first)
    term = F.encode("term", "UTF-8")
    met = met.where((first >= 0) & (held > 0) & (F.substring("around", first + 1, held) == F.substring(term, F.lit(1), held)))
    met = met.withColumn("start_at", F.col("at") - F.col("lead").cast("int")).withColumn("_whole", held == F.col("size"))
    hits = lambda df: df.select("doc_id", "text_hash", "entity_type", F.col("term").alias("value"), "start_at", (F.col("start_at") + F.length("term")).alias("end_at"), "detector_order")
    rows = hits(met.where("_whole"))
    if sizes["long"]:  # what begins like a term that is longer than what is at hand
        long = met.where(~F.col("_whole") & (F.col("size") > F.col("offset") + AFTER))
        texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.xxhash64("text").alias("_hash"))
        long = long.join(texts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
        rows = rows.unionByName(hits(long.where(F.substring("_text", F.col("start_at") + 1, F.length("term")) == F.col("term"))))
    rows = rows.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "entity_type", "detector_order", "value", "start_at")
    return rows.mapInArrow(_leftmost, rows.schema).drop("text_hash")
