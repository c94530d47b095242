"""MinHash near-duplicates with sequential Bayesian verification.

A text's set holds the 64-bit hashes of its word shingles; equal sets are one node. A set
has a signature of ``HASHES`` minima, in bands of ``ROWS``; sets that have a band in common
are candidates. With 32 bands of 4 a pair at 0.8 shares none with probability 5e-8.

Candidates are compared by batches of ``BATCH`` hashes. With a uniform prior, m of n equal
hashes leave a similarity that is Beta(m + 1, n - m + 1); a pair is pruned as soon as the
probability that it is at the threshold falls under ``MISS``. (Having a band in common
makes m larger, never smaller, so what this prunes is no likelier to be a link.) All
survivors are verified on full sets.

No group is spelled out as pairs. Each set is first paired with one other only: of the sets
that are the smallest of a bucket, the one it shares most buckets with. Buckets that still
span several components are dealt to blocks, compared in tasks between components alone,
and give spanning forests; what these hold together is compared as whole sets. Each
candidate pair is thus verified, pruned, or connected already.

Defined cases: texts that are null or without words have an empty set, link with nothing
and are their own component; repeated rows and equal texts are linked, and rows that
repeat a kept id are kept; null ids keep their rows (a component id is the smallest
non-null id), which are kept only if nothing with an id is linked to them; an empty table
gives an empty result; extra columns are ignored. A very long text is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from desense.llm import jaccard_join
from desense.llm.common import released, text_slices, written
from desense.llm.components import connected_components

#: Defaults: words in a shingle, and the threshold as a ratio of whole numbers.
SHINGLE, OVER, UNDER = 4, 80, 100
#: Hashes of a signature, and of a band; hashes compared at a time; chosen miss probability.
HASHES, ROWS, BATCH, MISS = 128, 4, 16, 1e-8
#: Elements hashed, and pairs compared, at a time.
CHUNK, PAIRS = 4096, 1 << 17

_MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = np.random.default_rng(12).integers(0, 1 << 63, HASHES // ROWS, dtype=np.uint64)


def signature(elements: np.ndarray) -> np.ndarray:
    """For each of ``HASHES`` hash functions, 32 bits of the least hash of an element."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(elements), CHUNK):
        np.minimum(least, np.multiply.outer(_MULTIPLIERS, elements[lo : lo + CHUNK]).min(1), out=least)
    return jaccard_join._mix(least).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A key of each band of each signature, different for different bands."""
    parts = signatures.reshape(len(signatures), -1, ROWS).astype(np.uint64)
    key = np.broadcast_to(_BAND_SALT, parts.shape[:2]).copy()
    for k in range(ROWS):
        key = jaccard_join._mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


@lru_cache(maxsize=None)
def least_matches(over: int, under: int, miss: float = MISS) -> list[int]:
    """How many hashes must be equal after each batch: with fewer, the posterior probability
    of a similarity of at least over / under is below ``miss``. For m of n equal hashes it
    is that of at most m successes in n + 1 trials at the threshold."""
    t, needed = over / under, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        needed.append(m)
    return needed


class Signatures:
    """The signatures of many sets, and which pairs of them survive the batches."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        self.values = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)

    def may_link(self, left: np.ndarray, right: np.ndarray, n: np.ndarray, over: int, under: int) -> np.ndarray:
        """Which pairs, of sets of sizes ``n``, can't be pruned."""
        ok = under * np.minimum(n[left], n[right]) >= over * np.maximum(n[left], n[right])
        found = np.flatnonzero(ok)
        ok[:] = False
        for part in (found[i : i + PAIRS] for i in range(0, len(found), PAIRS)):
            equal = np.zeros(len(part), np.int64)
            for k, least in enumerate(least_matches(over, under)):
                hashes = slice(k * BATCH, (k + 1) * BATCH)
                equal += (self.values[left[part], hashes] == self.values[right[part], hashes]).sum(1)
                stays = equal >= least
                part, equal = part[stays], equal[stays]
            ok[part] = True
        return ok


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, sketch): set_id and signature are null for empty sets;
    of equal sets in one batch the first row alone has the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets, seen, ids, signatures = jaccard_join.shingle_sets(batch.column("text"), shingle), set(), [], []
            for s in sets:
                ids.append(jaccard_join.set_id(s) if len(s) else None)
                new = ids[-1] is not None and ids[-1] not in seen
                seen.add(ids[-1])
                signatures.append(signature(s).tobytes() if new else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array(signatures, pa.binary())],
                names=["doc_id", "n_shingles", "set_id", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id long, sketch binary")


def banded(nodes: DataFrame) -> DataFrame:
    """(sig, set_id) of all sets that share a band with another; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(Signatures(batch.column("sketch")).values)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), batch.column("set_id").take(pa.array(np.repeat(np.arange(len(keys)), keys.shape[1])))], names=["sig", "set_id"])

    keys = nodes.select("set_id", "sketch").mapInArrow(run, "sig long, set_id long").repartition("sig")
    shared = keys.groupBy("sig").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low < high")
    return written(keys.join(shared.select("sig"), "sig"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, over: int = OVER, under: int = UNDER) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text); sets
    of ``shingle`` words link at a similarity of ``over / under``. Of each component the row
    with the smallest id is kept."""
    table = written(signed(docs, shingle))
    nodes = table.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"))
    nodes = written(nodes)
    members = banded(nodes)
    first_ids = nodes.select("set_id", "first_id")
    pairs = jaccard_join._likely_pairs(members, nodes, over, under)
    likely = written(jaccard_join._sketched(pairs, nodes, over, under, Signatures))
    sets = jaccard_join._sets_of(docs, likely.select(F.explode(F.array("a", "b")).alias("set_id")), first_ids, shingle)
    links = written(jaccard_join._verified(likely, sets, over, under))
    released(sets)
    labels = connected_components(links)
    state = jaccard_join._open_buckets(members, labels)
    if not state.isEmpty():
        possible = jaccard_join._possible_links(state, nodes, over, under, Signatures)
        families = connected_components(possible).select(F.col("node").alias("set_id"), F.col("root").alias("family"))
        families = written(families.join(state.select("set_id", "root").distinct(), "set_id"))
        released(state, labels)
        sets = jaccard_join._sets_of(docs, families.select("set_id"), first_ids, shingle)
        links = written(links.unionByName(jaccard_join._family_links(families, sets, over, under)))
        released(sets)
        labels = connected_components(links)
    released(members)
    rows = table.select("doc_id", "n_shingles", "set_id")
    found = jaccard_join._with_components(rows, first_ids, labels)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
