"""Replacement and redaction of texts, fragments and columns."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from desense.functions.replacement import default_replacement
from desense.operators import onepass
from desense.operators.detect import BUILT_INS, MOST_SPANS, compiled_rules, detect_terms, with_annotations, with_detector

MOST_POLICIES = 1000
#: Code points of a text that one bucket of offsets holds, for overlaps.
OFFSET_BUCKET = 4096


def resolve_replacement(spans: DataFrame, policies: DataFrame) -> DataFrame:
    """The replacement of each span: its own, else its type's first policy, else default.
    Policies are one row a type, few, and broadcast; of several for a type the one with
    the smallest policy_id counts (where there are none, the smallest replacement)."""
    order = "policy_id" if "policy_id" in policies.columns else "replacement"
    first = policies.groupBy("entity_type").agg(F.min_by("replacement", order).alias("_policy"))
    own = F.col("replacement") if "replacement" in spans.columns else F.lit(None).cast("string")
    text = F.coalesce(own, "_policy", default_replacement(F.col("entity_type"), F.col("value")))
    return spans.join(F.broadcast(first), "entity_type", "left").withColumn("replacement", text).drop("_policy")


def policy_map(policies: DataFrame) -> dict[str, str]:
    """The first policy of each type. Policies become part of the plan, so more than
    ``MOST_POLICIES`` types are refused."""
    order = "policy_id" if "policy_id" in policies.columns else "replacement"
    rows = policies.groupBy("entity_type").agg(F.min_by("replacement", order).alias("replacement")).limit(MOST_POLICIES + 1).collect()
    if len(rows) > MOST_POLICIES:
        raise ValueError(f"policies for more than {MOST_POLICIES} types")
    return {r["entity_type"]: r["replacement"] for r in rows if r["replacement"] is not None}


def redact_texts(docs: DataFrame, rules: DataFrame | None, policies: DataFrame, most_spans: int = MOST_SPANS, status: DataFrame | None = None, annotations: DataFrame | None = None, detector: Callable | None = None) -> DataFrame:
    """(doc_id, redacted, n_spans, error): detection, conflicts and redaction of whole
    documents in one scan without a shuffle. A user's ``detector`` (``with_detector``) adds
    its spans on the way; a document on which it fails fails alone. Or given ``status`` (doc_id, ok) of an annotation
    and its spans, documents whose annotation is missing or failed fail, and no text of
    theirs comes out; that takes a join by id, as do rules that are too many for a plan."""
    patterns, few, table = compiled_rules(rules)
    if detector is not None and status is not None:
        raise ValueError("a detector or an annotation, not both")
    rows = docs.select("doc_id", "text")
    if detector is not None:
        rows = with_detector(rows, detector).drop("failure")
    elif status is not None:
        rows = with_annotations(docs, status, annotations)
    if table is not None:
        if docs.isStreaming:
            raise ValueError("too many rules for a stream")
        hits = detect_terms(docs, table).groupBy("doc_id").agg(F.collect_list(F.struct(*onepass.FIELDS)).alias("listed"))
        rows = rows.join(hits.hint("merge"), "doc_id", "left")
    return onepass.redacted(rows, BUILT_INS + patterns, few, policy_map(policies), most_spans, status is not None or detector is not None, table is not None)


def redact_documents(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, redacted, n_spans, error) for every document. ``spans`` are the selected
    ones with a replacement; overlapping ones are an error, and no text comes out. Both meet
    by document, and neither is broadcast, however small it looks when packed."""
    edits = F.array_sort(F.collect_list(F.struct("start_at", "end_at", "replacement"))).alias("edits")
    grouped = spans.select("doc_id", "start_at", "end_at", "replacement").groupBy("doc_id").agg(edits)
    rows = docs.select("doc_id", "text").join(grouped.hint("merge"), "doc_id", "left")
    edits = F.coalesce("edits", F.array().cast("array<struct<start_at:int,end_at:int,replacement:string>>"))
    rows = rows.withColumn("edits", edits)
    starts, ends = F.slice(F.transform("edits", lambda e: e["start_at"]), 2, 1 << 30), F.transform("edits", lambda e: e["end_at"])
    clash = F.exists(F.zip_with(starts, ends, lambda s, e: F.coalesce(s < e, F.lit(False))), lambda x: x)
    error = F.when(clash, "OVERLAP")
    redacted = F.when(~clash, onepass.edited(F.col("text"), F.col("edits")))
    return rows.select("doc_id", redacted.alias("redacted"), F.size("edits").alias("n_spans"), error.alias("error"))


def redact_segments(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Plain and entity segments in order: (doc_id, seg_start, seg_end, entity_type, text).
    A document's disjoint spans go to its text once, which is cut in one walk; the segments
    of many texts leave a task together."""
    marks = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_at", "end_at", "entity_type"))).alias("marks"))
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("seg_start int, seg_end int, entity_type string, text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in onepass.runs(batch.column("text")):
                rows = batch.slice(first, n)
                cuts: list[tuple] = []
                for i, (text, own) in enumerate(zip(rows.column("text").to_pylist(), rows.column("marks").to_pylist(), strict=True)):
                    text, at = text or "", 0
                    parts = []
                    for m in own or []:
                        parts += [(at, m["start_at"], None), (m["start_at"], m["end_at"], m["entity_type"])]
                        at = m["end_at"]
                    cuts += [(i, a, b, kind, text[a:b]) for a, b, kind in [*parts, (at, len(text), None)] if a < b]
                if cuts:
                    of, *columns = zip(*cuts, strict=True)
                    made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(of)), *made], names=schema.names)

    return docs.select("doc_id", "text").join(marks, "doc_id", "left").mapInArrow(run, schema)


def fragment_offsets(fragments: DataFrame, separator: str = "") -> DataFrame:
    """Each fragment's [start_at, end_at) in the concatenation of its document's fragments."""
    order = Window.partitionBy("doc_id").orderBy("frag_no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text") + len(separator)).over(order) - len(separator)
    return fragments.withColumn("end_at", end.cast("int")).withColumn("start_at", F.col("end_at") - F.length("text"))


def joined_text(fragments: DataFrame, separator: str = "") -> DataFrame:
    """(doc_id, text): the concatenation."""
    parts = F.array_sort(F.collect_list(F.struct("frag_no", "text")))
    return fragments.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text"))


def piece_overlap(spans: DataFrame, pieces: DataFrame) -> DataFrame:
    """Spans x fragments of one document that overlap: an equi-join on document and bucket
    of offsets, with a range residual. A pair meets in several buckets if both reach into
    them, and counts in the first."""
    bucket = lambda at: F.floor(at / OFFSET_BUCKET).cast("int")
    spread = lambda df, a, b: df.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(a)), bucket(F.greatest(F.col(a), F.col(b) - 1)))))
    p = pieces.select("doc_id", "frag_no", F.col("start_at").alias("p_start"), F.col("end_at").alias("p_end"))
    met = spread(spans, "start_at", "end_at").join(spread(p, "p_start", "p_end"), ["doc_id", "_bucket"])
    first = F.col("_bucket") == bucket(F.greatest("start_at", "p_start"))
    return met.where((F.col("start_at") < F.col("p_end")) & (F.col("p_start") < F.col("end_at")) & first).drop("_bucket")


def redact_fragments(fragments: DataFrame, spans: DataFrame, separator: str = "") -> DataFrame:
    """Every fragment with its redacted text. A replacement stands where the span starts;
    what continues in later fragments is deleted; untouched fragments pass unchanged.

    Spans, which must be disjoint, and fragments come together by document once; a task walks
    over a document's fragments in order and holds its spans and one batch."""
    number = fragments.schema["frag_no"].dataType
    schema = StructType([fragments.schema["doc_id"], fragments.schema["frag_no"], StructField("redacted", StringType())])
    none = F.lit(None)
    marks = spans.select("doc_id", F.lit(0).alias("_kind"), F.col("start_at").cast("long").alias("_at"), F.col("end_at").cast("long").alias("_end"), none.cast(number).alias("frag_no"), F.col("replacement").alias("text"))
    parts = fragments.select("doc_id", F.lit(1).alias("_kind"), F.col("frag_no").cast("long").alias("_at"), none.cast("long").alias("_end"), "frag_no", "text")
    rows = marks.unionByName(parts).repartition("doc_id").sortWithinPartitions("doc_id", "_kind", "_at", "_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held, first, offset = object(), [], 0, 0
        for batch in batches:
            out, texts = [], []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "_kind", "_at", "_end", "text")]
            for i, (d, kind, at, end, text) in enumerate(zip(*columns, strict=True)):
                if d != doc:
                    doc, held, first, offset = d, [], 0, 0
                if kind == 0:
                    held.append((at, end, text or ""))
                    continue
                if text is not None:
                    begin, offset = offset, offset + len(text) + len(separator)
                    while first < len(held) and held[first][1] <= begin:
                        first += 1
                    text = _without(text, begin, held, first)
                out.append(i)
                texts.append(text)
            at = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("frag_no").take(at), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _without(text: str, begin: int, spans: list[tuple[int, int, str]], first: int) -> str:
    """A fragment that begins at ``begin``, with the spans from ``first`` on applied."""
    parts, at = [], 0
    for start, end, replacement in itertools.islice(spans, first, None):
        if start >= begin + len(text):
            break
        parts += (text[at : max(start - begin, at)], replacement if start >= begin else "")
        at = min(end - begin, len(text))
    return "".join([*parts, text[at:]])
