"""Approximate nearest neighbours along shifted Hilbert curves.

Each of ``CURVES`` curves orders all vectors by the Hilbert position of their shifted
projection on a few random directions. A curve is cut into ``BLOCKS`` ranges of about
equal counts, by exact counts of key prefixes; a query is compared with the vectors of
its own range and ``REACH`` neighbouring ranges on both sides. What the curves find is
merged and ranked by exact distances of the original vectors. Ranges with many vectors
or many queries are dealt to several tasks, so a task's work is bounded.

The ranges are shares of the table, so recall does not fall as it grows. Vectors that
have no structure need wide ranges: on unit vectors in 64 dimensions whose neighbours are
almost as far as everything else, these defaults find over 0.9 of the true neighbours.

Of equal vectors only the ``k + 1`` with the smallest ids are indexed; no other can be
among anyone's nearest k, for ties go to smaller ids. All rows, copies too, can query.

Defined cases: vectors that are null, zero, hold null or non-finite components, or are
not of the commonest length take no part, nor do rows with a null id; rows are told
apart by id, so repeated rows count once, and of several vectors with one id the smallest
counts; with fewer than k candidates all are returned;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from desense.llm.common import written
from desense.llm.hilbert import hilbert_keys

CURVES, DIRECTIONS, BITS = 16, 12, 2
BLOCKS, REACH = 100, 1
PREFIX_BITS = 14
TASK_VECTORS, TASK_QUERIES = 20_000, 4_000


@dataclass(frozen=True)
class Curves:
    """Projections, shifts and spreads of all curves; made from a seed and two moments."""

    directions: np.ndarray  # curve, component, direction
    shifts: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    bits: int

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Key of each vector on each curve."""
        found = []
        top = (1 << self.bits) - 1
        for c in range(len(self.directions)):
            share = (vectors @ self.directions[c] - self.mean[c]) / (5 * self.spread[c]) + 0.5
            cells = np.clip((share + self.shifts[c]) * 0.5 * top, 0, top).astype(np.int64)
            found.append(hilbert_keys(cells, self.bits))
        return np.array(found)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """Rows (vec_id, v) that take part, and the length of their vectors."""
    v = F.col("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    infinite = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, infinite) & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes["n"] if sizes else 1
    return rows.where(F.size("v") == dim), dim


def fit_curves(rows: DataFrame, dim: int, curves: int = CURVES, directions: int = DIRECTIONS, bits: int = BITS, seed: int = 7) -> Curves:
    """Curves for ``rows``; means and spreads along the directions are those of all rows."""
    random = np.random.default_rng(seed)
    p = min(directions, dim)
    axes = np.array([np.linalg.qr(random.normal(size=(dim, dim)))[0][:, :p] for _ in range(curves)])
    shifts = random.uniform(size=(curves, p))

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            yield pa.RecordBatch.from_pydict({"i": list(range(dim)), "n": [len(x)] * dim, "s": x.sum(0), "q": list((x.T @ x))}, schema=schema)

    schema = pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.float64()), ("q", pa.list_(pa.float64()))])
    moments = rows.select("v").mapInArrow(run, "i int, n long, s double, q array<double>")
    sums = moments.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), *[F.sum(F.col("q")[j]).alias(f"q{j}") for j in range(dim)])
    found = sorted(sums.collect())  # one row for each component
    if not found:
        return Curves(axes, shifts, np.zeros((curves, p)), np.ones((curves, p)), bits)
    n, mean = found[0]["n"], np.array([r["s"] / r["n"] for r in found])
    cov = np.array([[r[f"q{j}"] / n for j in range(dim)] for r in found]) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.einsum("cdp,de,cep->cp", axes, cov, axes), 1e-24))
    return Curves(axes, shifts, np.einsum("cdp,d->cp", axes, mean), spread, bits)


def nearest(
    vectors: DataFrame, is_query, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
    curves: int = CURVES, blocks: int = BLOCKS, reach: int = REACH, task_vectors: int = TASK_VECTORS, task_queries: int = TASK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query; ``is_query``
    is a condition on vec_id."""
    rows, dim = usable(vectors, id_column, vector_column)
    rows = written(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    model = fit_curves(rows, dim, curves)
    order = Window.partitionBy("v").orderBy("vec_id")
    indexed = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("vec_id", "v")
    drop = max(0, min(DIRECTIONS, dim) * BITS - PREFIX_BITS)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def keyed(batches):
        for batch in batches:
            keys = shared.value.keys(_matrix(batch.column("v"), dim)) >> drop
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(list(keys.T), pa.list_(pa.int64()))], names=["vec_id", "v", "keys"]
            )

    keyed_schema = "vec_id long, v array<double>, keys array<long>"
    table = written(indexed.mapInArrow(keyed, keyed_schema))
    queries = rows.where(is_query).mapInArrow(keyed, keyed_schema)
    # ranges of each curve from the counts of key prefixes: at most 2^PREFIX_BITS a curve
    counts = table.select(F.posexplode("keys").alias("curve", "key")).groupBy("curve", "key").count()
    upto = Window.partitionBy("curve").orderBy("key")
    whole = Window.partitionBy("curve")
    before = F.sum("count").over(upto) - F.col("count")
    ranges = counts.select("curve", "key", "count", F.floor(before * blocks / F.sum("count").over(whole)).cast("int").alias("block"))
    sizes = ranges.groupBy("curve", "block").agg(F.ceil(F.sum("count") / task_vectors).cast("int").alias("deals"))
    # numbered without gaps, as a key with many vectors fills more than one range
    sizes = sizes.withColumn("place", F.row_number().over(Window.partitionBy("curve").orderBy("block")))
    ranges = written(ranges.join(sizes, ["curve", "block"]).select("curve", "key", "place", "deals"))
    by_range = lambda df: df.select("vec_id", "v", F.posexplode("keys").alias("curve", "key"))
    candidates = by_range(table).join(F.broadcast(ranges.select("curve", "key", "place", "deals")), ["curve", "key"])
    candidates = candidates.select("curve", "place", F.pmod(F.xxhash64("vec_id"), "deals").cast("int").alias("deal"), "vec_id", "v")
    # a query's key may not occur among the indexed: it goes to the range of the last key before it
    spans = ranges.groupBy("curve", "place", "deals").agg(F.min("key").alias("low"))
    spans = written(spans.withColumn("high", F.lead("low").over(Window.partitionBy("curve").orderBy("place"))))
    at = (F.col("key") >= F.col("low")) & (F.col("key") < F.coalesce("high", F.lit(1 << 62))) | (F.col("key") < F.col("low")) & (F.col("place") == 1)
    placed = by_range(queries).join(F.broadcast(spans.select(F.col("curve").alias("c"), "place", "low", "high")), (F.col("curve") == F.col("c")) & at)
    placed = placed.select("curve", F.explode(F.sequence(F.col("place") - reach, F.col("place") + reach)).alias("place"), "vec_id", "v")
    placed = placed.join(F.broadcast(spans.select("curve", "place", "deals")), ["curve", "place"])
    # queries are dealt too, and candidates copied to each deal of queries
    placed = placed.select("curve", "place", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "vec_id", "v")
    asked_at = written(placed.groupBy("curve", "place").agg(F.ceil(F.count(F.lit(1)) / F.countDistinct("deal") / task_queries).cast("int").alias("query_deals")))
    asked_at = F.broadcast(asked_at)  # a row a range at most
    placed = placed.join(asked_at, ["curve", "place"]).withColumn("query_deal", F.pmod(F.xxhash64("vec_id"), "query_deals").cast("int"))
    candidates = candidates.join(asked_at, ["curve", "place"]).withColumn("query_deal", F.explode(F.sequence(F.lit(0), F.col("query_deals") - 1)))
    placed, candidates = (x.select("curve", "place", "deal", "query_deal", "vec_id", "v") for x in (placed, candidates))
    key = ["curve", "place", "deal", "query_deal"]
    found_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return found_schema.empty_table()
        x, ids = _matrix(held.column("v").combine_chunks(), dim), held.column("vec_id").to_numpy()
        q, asked_ids = _matrix(asked.column("v").combine_chunks(), dim), asked.column("vec_id").to_numpy()
        norms, out = (x * x).sum(1), []
        for lo in range(0, len(q), 64):
            part = q[lo : lo + 64]
            rough = (part * part).sum(1)[:, None] + norms[None] - 2 * part @ x.T
            slack = 1e-9 * ((part * part).sum(1) + norms.max())
            bound = np.partition(rough, min(k, len(x) - 1), axis=1)[:, min(k, len(x) - 1)]
            for i in range(len(part)):
                near = np.flatnonzero(rough[i] <= bound[i] + slack[i])
                near = near[ids[near] != asked_ids[lo + i]]
                score = np.sqrt(((x[near] - part[i]) ** 2).sum(1))
                best = np.lexsort((ids[near], score))[:k]
                out.append((np.full(len(best), asked_ids[lo + i]), ids[near][best], score[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=found_schema)

    found = placed.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
