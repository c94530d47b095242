"""Sequence labelling: best tag paths and spans from tags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Entity types of tag suffixes.
TYPES = {"PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "LOCATION"}


def softmax(values: Column, at: Column) -> Column:
    """Probability of element ``at`` (from 0)."""
    most = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - most))
    return F.exp(F.get(values, at) - most) / total


def best_paths(values: np.ndarray, sizes: np.ndarray, start: np.ndarray, end: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of several sequences, whose rows stand one after another in ``values``: all
    take their steps together, longest first, so that those still going are the first."""
    begins, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
    at, left = begins[order], sizes[order]
    score, back = values[at] + start, [np.zeros((len(sizes), len(start)), np.int16)]
    for t in range(1, int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -t))
        via = score[:m, :, None] + moves
        back.append(via.argmax(1).astype(np.int16))
        score[:m] = via.max(1) + values[at[:m] + t]
    tags = np.zeros(len(values), np.int32)
    now = (score + end).argmax(1)
    for t in range(len(back) - 1, -1, -1):
        m = int(np.searchsorted(-left, -t))
        tags[at[:m] + t] = now[:m]
        if t:
            now[:m] = back[t][np.arange(m), now[:m]]
    return tags


def decode_tag_path(emissions: DataFrame, start: list[float], end: list[float], transitions: list[list[float]]) -> DataFrame:
    """(seq_id, pos, tag): the best path over rows (seq_id, pos, values). Ties keep the
    lowest index. Sequences with a null, NaN or infinite value, or of another width, have
    no path (one row, pos and tag null). Sequences come together once, and a task holds
    those of a batch; time is linear in their rows."""
    k = len(start)
    matrices = np.array(start, float), np.array(end, float), np.array(transitions, float).reshape(k, k)
    schema = StructType([emissions.schema["seq_id"], StructField("pos", IntegerType()), StructField("tag", IntegerType())])

    def decoded(rows: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
        column = rows.column("values").combine_chunks()
        whole = pc.fill_null(pc.equal(pc.list_value_length(column), k), False).to_numpy(zero_copy_only=False)
        flat = column.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)
        values = np.full((len(rows), k), np.nan)
        values[whole] = flat
        sizes = np.diff(np.append(begins, len(rows)))
        good = np.logical_and.reduceat(np.isfinite(values).all(1), begins) if len(begins) else np.zeros(0, bool)
        own = np.repeat(good, sizes)
        tags = best_paths(values[own], sizes[good], *matrices)
        at = np.concatenate([np.flatnonzero(own), begins[~good]])
        pos = np.concatenate([np.arange(len(rows))[own] - np.repeat(begins[good], sizes[good]), np.full((~good).sum(), -1)])
        none = pos < 0
        return pa.RecordBatch.from_arrays([
            rows.column("seq_id").combine_chunks().take(pa.array(at)), pa.array(pos, pa.int32(), mask=none), pa.array(np.concatenate([tags, np.zeros(none.sum(), np.int32)]), pa.int32(), mask=none),
        ], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*held, batch])
            begins = _begins(rows)
            cut = int(begins[-1]) if len(begins) else 0
            if cut:
                yield decoded(rows.slice(0, cut), begins[:-1])
            held = rows.slice(cut).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield decoded(rows, _begins(rows))

    rows = emissions.select("seq_id", "pos", F.col("values").cast("array<double>").alias("values"))
    return rows.repartition("seq_id").sortWithinPartitions("seq_id", "pos").select("seq_id", "values").mapInArrow(run, schema)


def _begins(rows: pa.Table) -> np.ndarray:
    """Where the sequences of sorted rows begin."""
    ids = rows.column("seq_id").to_pylist()
    return np.array([i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]], np.int64)


def assemble_tag_spans(tags: DataFrame) -> DataFrame:
    """BIOES tags (seq_id, pos, label, score, start_at, end_at) to spans: (seq_id,
    entity_type, start_at, end_at, score).

    B and S close a pending span and open one; I and E extend a pending span or open one;
    E and S close. O does not close. The score is the opening tag's.
    """
    order = Window.partitionBy("seq_id").orderBy("pos")
    kind = F.left(F.col("label"), F.lit(1))
    on = tags.where(F.col("label") != "O").withColumn("k", kind)
    # after an E or S nothing is pending, so the next I or E opens too
    opens = F.col("k").isin("B", "S") | F.coalesce(F.lag("k").over(order).isin("E", "S"), F.lit(True))
    on = on.withColumn("n", F.sum(F.when(opens, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    suffix = F.min_by(F.expr("substring(label, 3)"), "pos")
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.col("suffix")], F.col("suffix"))
    # a B sets its own end; only I, E and S move it
    spans = on.groupBy("seq_id", "n").agg(suffix.alias("suffix"), F.min_by("start_at", "pos").alias("start_at"), F.max_by("end_at", "pos").alias("end_at"), F.min_by("score", "pos").alias("score"))
    return spans.select("seq_id", named.alias("entity_type"), "start_at", "end_at", "score")
