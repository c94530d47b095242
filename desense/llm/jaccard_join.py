"""N-gram Jaccard self-join by PartEnum signatures, and its components.

A text's set holds the 64-bit hashes of its word shingles. Sets fall into size bands in
which, and between neighbours of which, all pairs at the threshold lie. In a band the
threshold bounds the number k of differing elements. The hash space is cut into n1
parts, each into n2 smaller ones; a pair at the threshold has fewer than k2 + 1
differences in some of the n1 parts, so there all but k2 of the smaller parts are equal:
each subset of n2 - k2 smaller parts gives one signature, and such a pair shares one.
Cuts are by value of a mixed hash, so a part is a slice of the sorted set.

A subset without elements says nothing and gives no signature. Sets in which so many
parts have one that a pair might agree in such parts alone get, in addition, the
elements of a prefix of the sorted set as signatures: two sets at the threshold share
one of the first n - ceil(t n) + 1. So no pair is lost.

Equal sets are one node, known by a hash of the whole set. Nodes that share a signature
are candidates. Each set is first paired with one other only: of the sets that are the
smallest of a bucket, the one it shares most such buckets with. What then hangs together
need not be compared. In buckets that still span several components, sets of different components
are compared by sketches: how many elements fall in each of some classes of hashes.
Sums of the differences bound from below how many elements differ, so pairs they rule out
are no links. What the others hold together are families, and a family is compared as
whole sets, block by block inside tasks. Both comparisons give out spanning forests alone,
so a group of near copies costs a few rows a set. Every candidate pair is thus compared,
ruled out or connected already, so components are exact; and whole sets move for few.

Defined cases: texts that are null or without words have an empty set, link with nothing
and are their own component; repeated rows and equal texts are linked; null ids keep
their rows (a component id is the smallest non-null id); an empty table gives an empty
result; extra columns are ignored. Hashes of 64 bits make an error of about 1e-19 for
each pair of different shingles or sets compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from desense.llm.common import released, text_bytes, text_slices, word_spans, written
from desense.llm.components import connected_components

#: Defaults, of ``op8_jaccard_join``: words in a shingle, and the threshold as a ratio of
#: whole numbers. Bands and signatures are derived from the threshold.
SHINGLE = 4
OVER, UNDER = 85, 100
#: Bands with at most this many differences enumerate pairs out of three smaller parts.
ENUMERATED = 12
#: Classes of a sketch, one byte each: a power of two, so many that few elements share one.
LEAST_CLASSES, MOST_CLASSES, ELEMENTS_A_CLASS = 64, 4096, 16
#: A block of a bucket has about so many sets at most; so many pairs are compared at a time.
BUCKET_SETS, PAIRS_AT_ONCE, SKETCH_CELLS = 4000, 1 << 18, 1 << 24
#: A block of a family has about so many sets and elements at most.
BLOCK_SETS, BLOCK_ELEMENTS = 2000, 1_500_000
#: Elements of at most so many sets of a group are counted pair by pair.
COMMON_HOLDERS = 32
#: Tables of ids are broadcast up to this many bytes, and shuffled beyond.
BROADCAST_BYTES = 8 << 20

_M = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_ODD = [np.uint64(m) for m in _M]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), _ODD[0], np.uint64))]).astype(np.uint64)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, offsets = text_bytes(column)
    starts, stops, first = word_spans(~_IS_SPACE[raw], offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(column)
    lengths = stops - starts
    inside = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(len(inside)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    values = (_LOWER[raw[np.repeat(starts, lengths) + at]].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[at]
    hashes = np.add.reduceat(values, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    del inside, at, values
    hashes = _mix(hashes ^ (lengths.astype(np.uint64) << np.uint64(40)))
    run = np.zeros(len(hashes), np.uint64)
    for k in range(min(shingle, len(hashes))):
        run[: len(hashes) - k] += _mix(hashes[k:] + _ODD[1]) * np.uint64(2 * (k + 1) * (k + 7) + 1)
    run = _mix(run)
    sets = []
    for i in range(len(column)):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= shingle:
            sets.append(np.unique(run[lo : hi - shingle + 1]))
        elif hi > lo:
            whole = np.array([hi - lo], np.uint64)
            for h in hashes[lo:hi]:
                whole = _mix(whole * _ODD[2] + h)
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_id(elements: np.ndarray) -> int:
    """A hash of a whole set, as a signed 64-bit number."""
    total = np.array([_mix(elements + _ODD[3]).sum(dtype=np.uint64)])
    return int(_mix(total * _ODD[1] + np.uint64(len(elements))).view(np.int64)[0])


@lru_cache(maxsize=None)
def _bands(over: int = OVER, under: int = UNDER) -> tuple[list[int], list[int]]:
    """Smallest and largest set size of each band."""
    low, high = [1], [1]
    while high[-1] < 1 << 40:
        low.append(high[-1] + 1)
        high.append(max(low[-1], low[-1] * under // over))
    return low, high


@lru_cache(maxsize=None)
def plan(band: int, over: int = OVER, under: int = UNDER) -> tuple[int, int, int, int]:
    """n1, n2, k2 and how many of the n1 parts are sure to agree in a subset, for pairs
    whose larger set is in this band."""
    low, high = _bands(over, under)
    k = 2 * high[band] * (under - over) // (under + over)
    if k == 0:
        return 1, 1, 0, 1
    n2, k2 = (3, 1) if k <= ENUMERATED else (1, 0)
    sure, smallest = k // (k2 + 1), low[max(band - 1, 0)]

    def parts_with_an_empty_subset(n1: int) -> float:
        p = np.exp(-smallest / (n1 * n2))
        return n1 * (p if k2 == 0 else 3 * p * p)

    n1 = sure + 1
    while n2 == 1 and n1 < 2 * sure and n1 - sure < (m := parts_with_an_empty_subset(n1)) + 5 * m**0.5 + 1:
        n1 += 1
    return n1, n2, k2, n1 - sure


def signatures(elements: np.ndarray, over: int = OVER, under: int = UNDER) -> np.ndarray:
    """All signatures of a sorted set, in its own band and the next."""
    n = len(elements)
    low, high = _bands(over, under)
    own = int(np.searchsorted(high, n))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(elements + _ODD[2]), dtype=np.uint64)])
    found = []
    for band in (own, own + 1):
        n1, n2, k2, agree = plan(band, over, under)
        parts = n1 * n2
        step = ((1 << 64) - 1) // parts + 1
        cuts = np.arange(1, parts, dtype=np.uint64) * np.uint64(step) if parts > 1 else np.zeros(0, np.uint64)
        ends = np.concatenate([[0], np.searchsorted(elements, cuts), [n]])
        total, count = (sums[ends[1:]] - sums[ends[:-1]]).reshape(n1, n2), np.diff(ends).reshape(n1, n2)
        if k2:  # leave out one smaller part
            total, count = total.sum(1, dtype=np.uint64)[:, None] - total, count.sum(1)[:, None] - count
        salt = _mix(np.arange(n1 * n2, dtype=np.uint64) + np.uint64(band << 32)).reshape(n1, n2)
        filled = count > 0
        found.append(_mix(total * _ODD[0] + salt)[filled])
        if (~filled).any(1).sum() >= agree:
            prefix = n - -(-over * n // under) + 1
            found.append(_mix(elements[:prefix] * _ODD[3] + np.uint64((band << 32) + (1 << 31))))
    return np.concatenate(found).view(np.int64)


def shingled(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_id): set_id is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column("text"), shingle)
            ids = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), ids], names=["doc_id", "n_shingles", "set_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id long")


def signed_sets(docs: DataFrame, shingle: int = SHINGLE, over: int = OVER, under: int = UNDER) -> DataFrame:
    """(sig, set_id), each set once a partition: copies read by one task add nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in text_slices(batches):
            sigs, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s in shingle_sets(batch.column("text"), shingle):
                if len(s) and (i := set_id(s)) not in seen:
                    seen.add(i)
                    sigs.append(signatures(s, over, under))
                    ids.append(np.full(len(sigs[-1]), i))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(ids))], names=["sig", "set_id"])

    return docs.select("text").mapInArrow(run, "sig long, set_id long")


def classes_of(n: int) -> int:
    """Number of classes of the sketch of a set of size ``n``."""
    return min(max(LEAST_CLASSES, 1 << (-(-n // ELEMENTS_A_CLASS) - 1).bit_length()), MOST_CLASSES)


def sketch(elements: np.ndarray) -> bytes:
    """How many elements fall in each class, 255 for more. A class is the lowest bits of a
    hash, so halves of a sketch add up to the sketch with half the classes."""
    classes = classes_of(len(elements))
    return np.minimum(np.bincount((elements & np.uint64(classes - 1)).astype(np.int64), minlength=classes), 255).astype(np.uint8).tobytes()


class Sketches:
    """The sketches of many sets, with the classes that each pair of them has in common."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        self.raw = column.to_pylist()
        self.classes = np.array([len(x) for x in self.raw], dtype=np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, classes: int) -> tuple[np.ndarray, np.ndarray]:
        """Sketches of so many classes of all sets that have as many or more, and the row of
        each set in them."""
        if classes not in self.tables:
            own = np.flatnonzero(self.classes >= classes)
            row = np.zeros(len(self.raw), np.int64)
            row[own] = np.arange(len(own))
            counts = np.zeros((len(own), classes), np.uint16)
            for have in np.unique(self.classes[own]).tolist():
                these = own[self.classes[own] == have]
                whole = np.frombuffer(b"".join([self.raw[i] for i in these.tolist()]), np.uint8)
                counts[row[these]] = whole.reshape(len(these), have // classes, classes).sum(1, dtype=np.uint16)
            self.tables[classes] = row, counts
        return self.tables[classes]

    def may_link(self, left: np.ndarray, right: np.ndarray, n: np.ndarray, over: int, under: int) -> np.ndarray:
        """Which pairs of sets, of sizes ``n``, may be at the threshold."""
        common, ok = np.minimum(self.classes[left], self.classes[right]), np.zeros(len(left), bool)
        for classes in np.unique(common).tolist():
            row, counts = self.table(classes)
            at = np.flatnonzero(common == classes)
            step = max(1, SKETCH_CELLS // classes)
            for part in (at[i : i + step] for i in range(0, len(at), step)):
                x, y = counts[row[left[part]]], counts[row[right[part]]]
                both = n[left[part]] + n[right[part]]
                shared = (both - (np.maximum(x, y) - np.minimum(x, y)).sum(1, dtype=np.int64)) // 2
                ok[part] = under * shared >= over * (both - shared)
        return ok


def whole_sets(docs: DataFrame, shingle: int = SHINGLE, sketched: bool = False) -> DataFrame:
    """(set_id, n, elements) of each text, n the number of elements; or (set_id, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = [s for s in shingle_sets(batch.column("text"), shingle) if len(s)]
            last = pa.array([sketch(s) for s in sets], pa.binary()) if sketched else pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            ids, n = pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([ids, n, last], names=["set_id", "n", "sketch" if sketched else "elements"])

    return docs.select("text").mapInArrow(run, f"set_id long, n int, {'sketch binary' if sketched else 'elements array<long>'}")


def _small(ids: DataFrame) -> DataFrame:
    """A written table of ids (8 bytes a column), to be broadcast if it is small."""
    ids = written(ids)
    return F.broadcast(ids) if ids.count() * 8 * len(ids.columns) <= BROADCAST_BYTES else ids


def _among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows with the given ids; where ids are few, so that they are broadcast, what is
    shuffled later is only what will find a partner."""
    return rows.join(_small(ids.distinct()), column, "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """Those of the written pairs (a, b) of sets that are at the threshold."""
    side = lambda c: _among(sets, pairs.select(F.col(c).alias("set_id")), "set_id").select(F.col("set_id").alias(c), F.col("n").alias(f"n{c}"), F.col("elements").alias(f"e{c}"))
    both = F.size(F.array_intersect("ea", "eb"))
    found = pairs.join(side("b"), "b").join(side("a"), "a")
    return found.where(under * both >= over * (F.col("na") + F.col("nb") - both)).select("a", "b")


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, over: int = OVER, under: int = UNDER) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text); sets of
    ``shingle`` words link at a similarity of ``over / under``."""
    return component_rows(docs, shingle, over, under).select("doc_id", "n_shingles", "component_id")


def with_set_id(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, with set_id as a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            ids = pa.array([set_id(s) if len(s) else None for s in shingle_sets(batch.column("text"), shingle)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "set_id"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("set_id", LongType())]))


def component_rows(docs: DataFrame, shingle: int = SHINGLE, over: int = OVER, under: int = UNDER) -> DataFrame:
    """As ``jaccard_components``, with set_id and root, a set_id that a component's rows
    have in common; both are null for empty sets."""
    rows = written(shingled(docs, shingle))
    nodes = written(rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first_id")))
    members = _members(docs, shingle, over, under)
    labels = _linked(docs, members, nodes, shingle, over, under)
    released(members)
    return _with_components(rows, nodes, labels)


def _members(docs: DataFrame, shingle: int, over: int, under: int) -> DataFrame:
    """(sig, set_id) of all sets that share a signature with another; a written table."""
    sigs = signed_sets(docs, shingle, over, under).repartition("sig")
    shared = sigs.groupBy("sig").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low < high")
    return written(sigs.join(shared.select("sig"), "sig").distinct())


def _sets_of(docs: DataFrame, ids: DataFrame, nodes: DataFrame, shingle: int, sketched: bool = False) -> DataFrame:
    """``whole_sets`` of the sets with these ids, from one text each; a written table."""
    wanted = written(ids.distinct().join(nodes, "set_id"))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    named = wanted.where("first_id is not null").select(F.col("first_id").alias("doc_id"))
    # an id that several texts have brings sets that are not asked for, or that come twice
    sets = whole_sets(_among(texts, named, "doc_id"), shingle, sketched)
    unnamed = wanted.where("first_id is null").select("set_id")  # only rows without an id have these
    if not unnamed.isEmpty():
        sets = sets.unionByName(_among(whole_sets(texts.where("doc_id is null"), shingle, sketched), unnamed, "set_id"))
    sets = written(sets)
    if not sets.groupBy("set_id").count().where("count > 1").isEmpty():
        sets = written(sets.dropDuplicates(["set_id"]))
    return sets


def _linked(docs: DataFrame, members: DataFrame, nodes: DataFrame, shingle: int, over: int, under: int) -> DataFrame:
    """(node, root) of all sets that link with another."""
    sketches = _sets_of(docs, members.select("set_id"), nodes, shingle, sketched=True)
    likely = written(_sketched(_likely_pairs(members, sketches, over, under), sketches, over, under))
    sets = _sets_of(docs, likely.select(F.explode(F.array("a", "b")).alias("set_id")), nodes, shingle)
    links = written(_verified(likely, sets, over, under))
    released(sets)
    labels = connected_components(links)
    state = _open_buckets(members, labels)
    if not state.isEmpty():
        families = connected_components(_possible_links(state, sketches, over, under)).select(F.col("node").alias("set_id"), F.col("root").alias("family"))
        families = written(families.join(state.select("set_id", "root").distinct(), "set_id"))
        released(state, labels)
        sets = _sets_of(docs, families.select("set_id"), nodes, shingle)
        links = written(links.unionByName(_family_links(families, sets, over, under)))
        released(sets)
        labels = connected_components(links)
    return labels


def _likely_pairs(members: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """One pair (a, b) at most for each set b: a is the smallest set of a bucket, of like
    size, and shares most such buckets with b."""
    low = members.groupBy("sig").agg(F.min("set_id").alias("a"))
    shared = members.withColumnRenamed("set_id", "b").join(low, "sig").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("buckets"))
    size = lambda c: sets.select(F.col("set_id").alias(c), F.col("n").alias(f"n{c}"))
    near = under * F.least("na", "nb") >= over * F.greatest("na", "nb")
    pairs = shared.join(size("a"), "a").join(size("b"), "b").where(near)
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("buckets", "a")).alias("a")).select("a", "b")


def _sketched(pairs: DataFrame, sets: DataFrame, over: int, under: int, kind: type = Sketches) -> DataFrame:
    """The pairs (a, b) that sketches, which ``kind`` compares, allow to link."""
    side = lambda c: sets.select(F.col("set_id").alias(c), F.col("n").cast("long").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.arange(batch.num_rows)
            both = kind(pa.chunked_array([batch.column("sa"), batch.column("sb")]))
            n = np.concatenate([batch.column("na").to_numpy(), batch.column("nb").to_numpy()])
            ok = both.may_link(rows, rows + len(rows), n, over, under)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(run, "a long, b long")


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (sig, set_id, root) of the buckets that span several components; a written
    table."""
    labelled = members.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    labelled = labelled.select("sig", "set_id", F.coalesce("root", "set_id").alias("root"))
    spans = labelled.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("sig")
    return written(labelled.join(spans, "sig"))


def _possible_links(state: DataFrame, sets: DataFrame, over: int, under: int, kind: type = Sketches) -> DataFrame:
    """Pairs (a, b) that connect, directly or over others, all sets of different components
    that share an open bucket and that sizes and sketches allow to link.

    A bucket is dealt to blocks of bounded size, and each two blocks are compared where
    the shuffle brings them, so no task needs a bucket as a whole.
    """
    blocks = state.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BUCKET_SETS).cast("int").alias("blocks"))
    dealt = state.join(blocks, "sig").withColumn("own", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "root", "set_id")
    rows = dealt.join(sets.select("set_id", "n", "sketch"), "set_id").repartition("sig", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches):
            a, b = possible_forest(part, over, under, kind)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.sortWithinPartitions("sig", "i", "j", "own", "root").mapInArrow(run, "a long, b long").distinct()


def _family_links(families: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """Links (a, b) between the components (root) of each family, for rows (set_id, family,
    root).

    A family is dealt to blocks of bounded sets and elements, each pair of blocks is one
    task's group, and a group gives a spanning forest of its links.
    """
    placed = families.select("set_id", "family", "root")
    placed = written(placed.join(sets.select("set_id", "n"), "set_id"))
    sizes = placed.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    dealt = placed.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("set_id", "family", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = dealt.join(_among(sets.select("set_id", "elements"), placed.select("set_id"), "set_id"), "set_id")

    def forest(group: pa.Table) -> pa.Table:
        elements = group.column("elements").combine_chunks()
        own, root, ids = (group.column(c).to_numpy() for c in ("own", "root", "set_id"))
        values, ends = np.asarray(elements.flatten()), np.cumsum(np.asarray(pc.list_value_length(elements)))
        a, b = linked_forest(values, ends, own, root, over, under)
        return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b])})

    return rows.groupBy("family", "i", "j").applyInArrow(forest, "a long, b long")


def linked_forest(values: np.ndarray, ends: np.ndarray, own: np.ndarray, root: np.ndarray, over: int = OVER, under: int = UNDER) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked among the sets whose elements end at ``ends``: of
    different ``root``, and if ``own`` has two values, of different values of it.

    Elements that many sets hold are counted by matrix products, rare ones pair by pair;
    elements of one set alone can't be shared.
    """
    n, none = len(ends), np.zeros(0, np.int64)
    if n and root.min() == root.max():
        return none, none
    sizes = np.diff(np.concatenate([[0], ends]))
    of = np.repeat(np.arange(n), sizes)
    _, element = np.unique(values, return_inverse=True)
    order = np.lexsort((of, element))
    of, element = of[order], element[order]
    starts = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]]))
    holders = np.diff(np.concatenate([starts, [len(of)]]))
    shared = np.zeros((n, n), np.float32)
    common = np.flatnonzero(holders > COMMON_HOLDERS)
    for lo in range(0, len(common), 1024):
        part = common[lo : lo + 1024]
        rows = np.concatenate([of[starts[k] : starts[k] + holders[k]] for k in part])
        held = np.zeros((n, len(part)), np.float32)
        held[rows, np.repeat(np.arange(len(part)), holders[part])] = 1
        shared += held @ held.T
    flat = shared.reshape(-1)
    for size in np.unique(holders[(holders > 1) & (holders <= COMMON_HOLDERS)]).tolist():
        at = starts[holders == size]
        for lo in range(0, len(at), 4096):
            who = of[at[lo : lo + 4096, None] + np.arange(size)]
            pairs = (who[:, :, None] * n + who[:, None, :]).reshape(-1)
            where, count = np.unique(pairs, return_counts=True)
            flat[where] += count
    both = sizes[:, None] + sizes[None, :]
    linked = under * shared >= over * (both - shared)
    linked &= root[:, None] != root[None, :]
    if own.min() != own.max():
        linked &= own[:, None] != own[None, :]
    # breadth first from each set not yet reached
    left, a, b = np.ones(n, bool), [], []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            reached = np.flatnonzero(linked[front].any(0) & left)
            if len(reached):
                parent = front[linked[front][:, reached].argmax(0)]
                a.append(parent)
                b.append(reached)
                left[reached] = False
            front = reached
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _changes(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """For each row but the first, whether it differs from the row before."""
    values = [rows.column(c).to_numpy() for c in columns]
    return np.any([v[1:] != v[:-1] for v in values], axis=0)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Record batches sorted by (sig, i, j) as tables that never end within such a group."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.Table.from_batches([*kept, batch])
        last = np.flatnonzero(_changes(rows, ["sig", "i", "j"])) if len(rows) > 1 else []
        if len(last):
            yield rows.slice(0, last[-1] + 1)
            rows = rows.slice(last[-1] + 1)
        kept = rows.to_batches()
    if kept:
        yield pa.Table.from_batches(kept)


def possible_forest(rows: pa.Table, over: int, under: int, kind: type = Sketches) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what may link within groups (sig, i, j) of rows sorted by group,
    block and root: of two blocks one set of each, of one block two of different roots."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own, root, ids, i, j = (rows.column(c).to_numpy() for c in ("own", "root", "set_id", "i", "j"))
    sketches, n, total = kind(rows.column("sketch")), rows.column("n").to_numpy().astype(np.int64), len(rows)
    group = _changes(rows, ["sig", "i", "j"])
    run = group | (own[1:] != own[:-1]) | ((i == j)[1:] & (root[1:] != root[:-1]))
    ends = [np.append(np.flatnonzero(new) + 1, total) for new in (group, run)]
    group_end, run_end = (e[np.searchsorted(e, np.arange(total), side="right")] for e in ends)
    partners = group_end - run_end
    upto, lo, label = np.cumsum(partners), 0, np.arange(total)
    while lo < total:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
        many = partners[lo:hi]
        left = np.repeat(np.arange(lo, hi), many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(run_end[lo:hi], many)
        like = (label[left] != label[right]) & (root[left] != root[right]) & (under * np.minimum(n[left], n[right]) >= over * np.maximum(n[left], n[right]))
        left, right, lo = left[like], right[like], hi
        ok = sketches.may_link(left, right, n, over, under)
        _connect(label, left[ok], right[ok])
    below = np.flatnonzero(label != np.arange(total))
    return ids[label[below]], ids[below]


def _connect(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Give all rows that the pairs connect the smallest of their labels, in place."""
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(shorter := label[label], label):
            label[:] = shorter


def _with_components(rows: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    rooted = written(nodes.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "first_id", F.coalesce("root", "set_id").alias("root")))
    firsts = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    of_set = written(rooted.join(firsts, "root").select("set_id", "root", "component_id"))
    released(nodes, labels, rooted, firsts)
    out = rows.where("set_id is not null").join(of_set, "set_id").select("doc_id", "n_shingles", "component_id", "set_id", "root")
    return out.unionByName(rows.where("set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "set_id", F.lit(None).cast("long").alias("root")))


def first_documents(docs: DataFrame, shingle: int = SHINGLE, over: int = OVER, under: int = UNDER) -> DataFrame:
    """The rows of ``docs`` with one row left of each group of linked documents: the one
    with the smallest id. Rows without an id can't be told apart, so all of them stay; of
    several texts that have the smallest id of their group one stays, and texts of
    different groups stay even if they share an id.

    Texts are not moved but where rows share an id: the ids to drop, which are fewer than
    the rows, are joined, by broadcast as long as they are small.
    """
    found = component_rows(docs, shingle, over, under).where("doc_id is not null")
    first = F.col("doc_id") == F.col("component_id")
    # of several sets of a group with the smallest id one stays
    chosen = found.where(first & F.col("root").isNotNull()).groupBy("doc_id", "root").agg(F.min("set_id").alias("set_id"))
    stays = written(chosen.select("doc_id", "set_id").unionByName(found.where("root is null").select("doc_id", "set_id").distinct()))
    rows_of = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    kept_of = stays.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))
    fate = rows_of.join(kept_of, "doc_id", "left").select("doc_id", F.when(F.col("kept").isNull(), "drop").when(F.col("rows") > 1, "look").alias("fate"))
    fate = written(fate.where("fate is not null"))
    id_of = docs.withColumn("_id", F.col("doc_id").cast("long"))
    ids = lambda what: _small(fate.where(F.col("fate") == what).select(F.col("doc_id").alias("_id")))
    out = id_of.join(_small(fate.select(F.col("doc_id").alias("_id"))), "_id", "left_anti").select(*docs.columns)
    shared = ids("look")
    if shared.isEmpty():
        return out
    several = with_set_id(id_of.join(shared, "_id", "left_semi"), shingle)
    same = (several["_id"] == stays["doc_id"]) & several["set_id"].eqNullSafe(stays["set_id"])
    several = several.join(stays, same, "left_semi").dropDuplicates(["_id", "set_id"])
    return out.unionByName(several.select(*docs.columns))
