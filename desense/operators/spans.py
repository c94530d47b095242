"""Span sets: validation, caps, conflict resolution, offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from desense.functions.replacement import type_label
from desense.operators import onepass


#: Which of overlapping spans comes first.
PRIORITY = [("score", "descending"), ("_bytes", "descending"), ("start_at", "ascending"), ("entity_type", "ascending"), ("detector_order", "ascending"), ("entity_id", "ascending")]


def valid_entities(spans: DataFrame) -> DataFrame:
    """Finite scores from 0 to 1 and start before end."""
    return spans.where(~F.isnan("score") & F.col("score").between(0, 1) & (F.col("start_at") < F.col("end_at")))


def validate_spans(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, valid): whether all spans of a document lie inside its text."""
    inside = (F.col("start_at") >= 0) & (F.col("start_at") < F.col("end_at")) & (F.col("end_at") <= F.col("n"))
    sizes = docs.select("doc_id", F.length("text").alias("n"))
    return spans.select("doc_id", "start_at", "end_at").join(sizes, "doc_id").groupBy("doc_id").agg(F.bool_and(inside).alias("valid"))


def default_selection(score: Column, threshold: float = onepass.SELECTED) -> Column:
    return score >= threshold


def entity_cap(spans: DataFrame, most: int) -> DataFrame:
    """(doc_id, n, error) of each document with spans."""
    n = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("doc_id", "n", F.when(F.col("n") > most, "TOO_MANY_ENTITIES").alias("error"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by document and place, those that stay. An island is a run of spans
    that touch by overlap; a batch's last island may go on in the next. A batch is sorted by
    priority once, whatever its islands."""
    held: pa.Table | None = None

    def islands(rows: pa.Table) -> np.ndarray:
        """Where an island begins, after the first."""
        doc, start, end = (rows.column(c).to_numpy() for c in ("doc_id", "start_at", "end_at"))
        number = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]).astype(np.int64) << 32
        reach = np.maximum.accumulate(number + end)
        return np.flatnonzero((number + start)[1:] >= reach[:-1]) + 1

    def chosen(rows: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.concatenate([[0], begins])
        size = np.diff(np.append(first, len(rows)))
        kept = [first[size == 1]]
        island = np.repeat(np.arange(len(size)), size)
        at = np.flatnonzero(size[island] > 1)
        if len(at):
            many = rows.take(pa.array(at))
            rank = np.argsort(pc.sort_indices(many, sort_keys=PRIORITY).to_numpy())
            order = np.lexsort([rank, island[at]]).tolist()
            start, end = (many.column(c).to_pylist() for c in ("start_at", "end_at"))
            upto = np.cumsum(size[size > 1]).tolist()
            stay = [i for a, b in zip([0, *upto], upto, strict=False) for i in onepass.disjoint(order[a:b], start, end)]
            kept.append(at[stay])
        yield from rows.take(np.sort(np.concatenate(kept))).drop_columns(["_bytes"]).to_batches()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not len(rows):
            continue
        begins = islands(rows)
        cut = int(begins[-1]) if len(begins) else 0
        if cut:
            yield from chosen(rows.slice(0, cut), begins[:-1])
        held = rows.slice(cut)
    if held is not None and len(held):
        yield from chosen(held, islands(held))


def resolve_conflicts(spans: DataFrame, byte_length: Column | None = None) -> DataFrame:
    """A non-overlapping set of valid spans by priority: score, length in bytes, start,
    type, detector order (then id). Rows that are one span twice overlap, so one stays.

    Spans are brought together and sorted once, by document and place; each task then walks
    over overlap islands, which are independent, and holds one at a time. Spans without an
    id get theirs (``with_entity_id``) once they are together, so that it is not shuffled.
    """
    size = byte_length if byte_length is not None else F.octet_length("value")
    rows = valid_entities(spans).withColumn("_bytes", size).repartition("doc_id")
    rows = rows if "entity_id" in spans.columns else with_entity_id(rows)
    ordered = rows.sortWithinPartitions("doc_id", "start_at", "end_at", "entity_id")
    return ordered.mapInArrow(_kept, rows.drop("_bytes").schema)


def with_entity_id(spans: DataFrame) -> DataFrame:
    """A reproducible id from what identifies a span."""
    parts = F.concat_ws("|", "doc_id", "start_at", "end_at", "entity_type", "detector_order")
    return spans.withColumn("entity_id", F.sha2(parts, 256))


def offset_units(text: Column, at: Column) -> tuple[Column, Column]:
    """A code-point offset as UTF-8 bytes and as UTF-16 units."""
    head = F.left(text, at)
    return F.octet_length(head), (F.octet_length(F.encode(head, "UTF-16BE")) / 2).cast("int")


def located(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans (doc_id, start_at, end_at, ..) with value, the text they cover, and their ends
    in UTF-8 bytes (start_byte, end_byte) and UTF-16 units (start_utf16, end_utf16). A
    document's spans go to its text once, whose characters are measured once, those of many
    texts together; offsets beyond the text count as its end, and spans without a text are
    left out."""
    own = [c for c in spans.columns if c not in ("doc_id", "value")]
    rows = docs.select("doc_id", "text").where("text is not null").join(spans.groupBy("doc_id").agg(F.collect_list(F.struct(*own)).alias("_spans")), "doc_id")
    made = StructType.fromDDL("value string, start_byte int, end_byte int, start_utf16 int, end_utf16 int")
    schema = StructType([docs.schema["doc_id"], *(spans.schema[c] for c in own), *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in onepass.runs(batch.column("text")):
                part = batch.slice(first, n)
                texts, lists = part.column("text").to_pylist(), part.column("_spans")
                marks, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
                # the texts in one, each from its place in it on
                text, size = "".join(texts), np.array([len(t) for t in texts])
                code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                widths = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1 + (code > 0xFFFF)
                sums = [np.concatenate([[0], np.cumsum(w)]) for w in widths]
                base = (np.cumsum(size) - size)[row]
                fields = dict(zip(own, marks.flatten(), strict=True))
                start, end = (base + np.clip(fields[c].fill_null(0).to_numpy(zero_copy_only=False), 0, size[row]) for c in ("start_at", "end_at"))
                units = [pa.array((s[at] - s[base]).astype(np.int32)) for s in sums for at in (start, end)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(row)), *(fields[c] for c in own),
                    pa.array([text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.string()), *units,
                ], names=schema.names)

    return rows.select("doc_id", "text", "_spans").mapInArrow(run, schema)


def entity_view(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Label, sliced text and UTF-16 display span of each entity."""
    rows = located(spans.select("doc_id", "entity_type", "start_at", "end_at"), docs)
    return rows.select("doc_id", "entity_type", type_label(F.col("entity_type")).alias("label"), "value", F.col("start_utf16").alias("display_start"), F.col("end_utf16").alias("display_end"))


def entity_search(views: DataFrame, query: str) -> DataFrame:
    """Case-sensitive search in text and label."""
    return views.where(F.contains(F.concat("value", "label"), F.lit(query)))
