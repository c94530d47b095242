"""Detectors: one document row gives many span rows.

Spans are half open, in code points: (doc_id, entity_type, value, start_at, end_at,
score, source, detector_order). Built-in patterns and regex rules run as expressions in
the row, terms in one walk over the text; both in one pass (``onepass``). Rules are a
small table that the caller has validated (``validate_rules``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from desense.functions.linear import needs_linear, to_linear
from desense.operators import onepass, terms
from desense.operators.onepass import MOST_SPANS, Pattern, Term

#: Type, pattern, score, whether a digit may stand next to it.
PATTERNS = [
    ("PHONE", r"1[3-9][0-9]{9}", 0.95, False),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.95, True),
    ("ID_CARD", r"[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]", 0.9, False),
]
#: The same matches in time linear in the text: a local part is tried where its run of
#: characters begins or the match before ended, and never in parts.
LINEAR = {"EMAIL": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}
BUILT_IN, CUSTOM = "built-in", "custom rule"
MOST_RULE_BYTES, MOST_TERMS = 64 * 1024, 2000
#: Rules of a job, and the bytes of a dictionary's terms that one scan looks for.
MOST_RULES, MOST_DICTIONARY_BYTES = 1000, 32 << 20
#: Windows of one text that leave a task at a time.
CHUNKS_AT_ONCE = 4096
#: Java matches these, the rule language does not allow them.
REFUSED = r"\(\?<?[=!]|(?<!\\)(?:\\\\)*\\[1-9k]"
SPAN = onepass.FIELDS
#: Spans of an annotation of a document.
ANNOTATION = "array<struct<entity_type:string,start_at:int,end_at:int,score:double,source:string>>"
BUILT_INS = [Pattern(t, LINEAR.get(t, p), score, BUILT_IN, i + 1, beside, "@" if t == "EMAIL" else "") for i, (t, p, score, beside) in enumerate(PATTERNS)]
_LINES = re.compile(r"\r?\n")


def dictionary_terms(pattern: str) -> list[str]:
    """One term a line, without white space around it; blank lines are no terms, and a term
    that comes again is one."""
    return list(dict.fromkeys(t for t in map(str.strip, _LINES.split(pattern)) if t))


def compiled_rules(rules: DataFrame | None, kind: str | None = None) -> tuple[list[Pattern], list[Term], DataFrame | None]:
    """Patterns and terms of the enabled rules, and a table of terms. Few rules become part
    of the plan; where there are more than ``MOST_RULES``, or terms of more than
    ``MOST_DICTIONARY_BYTES``, literals and dictionaries stay a table (``rule_terms``), and
    regular expressions, each of which is a search of its own, are refused beyond it."""
    if rules is None:
        return [], [], None
    on = rules.where("enabled") if kind is None else rules.where(F.col("enabled") & (F.col("kind") == kind))
    on = on.select("rule_id", "entity_type", "kind", "pattern")
    n, size = on.agg(F.count(F.lit(1)), F.sum(F.when(F.col("kind") != "regex", F.octet_length("pattern")))).first()
    table = None
    if n > MOST_RULES or (size or 0) > MOST_DICTIONARY_BYTES:
        table, on = rule_terms(on.where("kind <> 'regex'").withColumn("enabled", F.lit(True))), on.where("kind = 'regex'")
    rows = on.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} regular expressions")
    patterns, found = [], []
    for r in sorted(rows):
        if r["kind"] == "regex":
            own = to_linear(r["pattern"]) if needs_linear(r["pattern"]) else None
            patterns.append(Pattern(r["entity_type"], "(?Ud)" + r["pattern"], 1.0, CUSTOM, 100 + r["rule_id"], linear=own))
        else:
            own = dictionary_terms(r["pattern"]) if r["kind"] == "dictionary" else [r["pattern"]]
            found += [Term(r["entity_type"], t, CUSTOM, 100 + r["rule_id"]) for t in own]
    return patterns, found, table


def detect_pattern(docs: DataFrame, name: str) -> DataFrame:
    """Spans of one built-in pattern."""
    return onepass.all_spans(docs, [p for p in BUILT_INS if p.entity_type == name], [])


def detect_rules(docs: DataFrame, rules: DataFrame, kind: str | None = None) -> DataFrame:
    """Spans of the enabled rules; each dictionary term is matched on its own."""
    return _all_spans(docs, [], rules, kind)


def _all_spans(docs: DataFrame, built_in: list[Pattern], rules: DataFrame | None, kind: str | None = None) -> DataFrame:
    patterns, few, table = compiled_rules(rules, kind)
    found = onepass.all_spans(docs, built_in + patterns, few)
    return found if table is None else found.unionByName(detect_terms(docs, table).select(*found.columns))


def detect_terms(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Spans of a dictionary of any size, a table (entity_type, term), with detector_order
    where it is not to be 100: places of seeds joined with the terms (``terms``). Of
    overlapping hits of one term the leftmost stay; rows of ``docs`` that are equal count
    once."""
    order = F.col("detector_order").cast("int") if "detector_order" in dictionary.columns else F.lit(100)
    known = dictionary.where("term <> ''").select("entity_type", "term", order.alias("detector_order")).distinct()
    hits = terms.term_hits(docs, known)
    return hits.select("doc_id", "entity_type", "value", "start_at", "end_at", F.lit(1.0).alias("score"), F.lit(CUSTOM).alias("source"), "detector_order")


def rule_terms(rules: DataFrame) -> DataFrame:
    """(entity_type, term, detector_order) of the enabled literal and dictionary rules."""
    lines = F.filter(F.transform(F.split("pattern", r"\r?\n"), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != "")
    own = F.when(F.col("kind") == "dictionary", lines).when(F.col("kind") == "literal", F.array("pattern"))
    return rules.where("enabled").select("entity_type", F.explode(own).alias("term"), (F.col("rule_id") + 100).cast("int").alias("detector_order"))


def detect_all(docs: DataFrame, rules: DataFrame | None = None, annotations: DataFrame | None = None) -> DataFrame:
    """All detectors in one scan, and spans from outside (detector order 0) where given."""
    spans = _all_spans(docs, BUILT_INS, rules)
    if annotations is not None:
        spans = spans.unionByName(annotations.withColumn("detector_order", F.lit(0)).select("doc_id", *SPAN))
    return spans


def with_annotations(docs: DataFrame, status: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with what an annotation says of them, for ``onepass``: ok from
    ``status`` (doc_id, ok), null where it is missing and false where any row is not ok, and
    its spans as an array."""
    ok = status.groupBy("doc_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))
    found = spans.groupBy("doc_id").agg(F.collect_list(F.struct("entity_type", "start_at", "end_at", F.col("score").cast("double").alias("score"), "source")).alias("spans"))
    return docs.select("doc_id", "text").join(ok, "doc_id", "left").join(found, "doc_id", "left")


def judged_annotations(docs: DataFrame, status: DataFrame) -> DataFrame:
    """``docs`` with an error where the annotation is missing or failed, else null. ``status``
    is (doc_id, ok); one row that is not ok fails its document. Both meet by document once."""
    ok = status.groupBy("doc_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("_ok"))
    error = F.when(~F.coalesce("_ok", F.lit(False)), "MODELS_NOT_READY")
    return docs.join(ok, "doc_id", "left").withColumn("error", error).drop("_ok")


def require_annotations(docs: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents whose annotation is done, and those that must fail: annotation missing or
    failed (``judged_annotations``)."""
    rows = judged_annotations(docs, status)
    return rows.where("error is null").drop("error"), rows.where("error is not null")


def with_detector(docs: DataFrame, detector: Callable) -> DataFrame:
    """``docs`` (doc_id, text) with ok and spans, as an annotation has them, of a user's
    detector: a function on iterators of pandas frames, (doc_id, text) in, (doc_id,
    entity_type, start_at, end_at, score) out, for the rows of one frame in one.

    It fails by document: where it raises on a frame, or gives out what is no span of it, the
    halves of the frame are tried, and a row that fails alone is not ok. Of a frame that
    failed and whose first half is good, the second half is not tried whole again. Rows are
    told apart by their place, whatever their ids; the detector sees places as ids.
    """
    schema = StructType([*docs.select("doc_id", "text").schema.fields, *StructType.fromDDL(f"ok boolean, spans {ANNOTATION}, failure string").fields])

    def tried(frame: pd.DataFrame) -> dict[int, list[dict]]:
        texts, found = dict(zip(frame["doc_id"].tolist(), frame["text"].tolist(), strict=True)), {}
        for hits in detector(iter([frame])):
            for p, kind, a, b, score in zip(*(hits[c].tolist() for c in ("doc_id", "entity_type", "start_at", "end_at", "score")), strict=True):
                text, a, b = texts[p], int(a), int(b)
                if not (0 <= a < b <= len(text) and 0 <= float(score) <= 1 and isinstance(kind, str)):
                    raise ValueError(f"no span of its text: {a} to {b}, score {score}")
                found.setdefault(p, []).append({"entity_type": kind, "start_at": a, "end_at": b, "score": float(score), "source": "model"})
        return found

    def judged(frame: pd.DataFrame, bad: bool, out: dict) -> bool:
        """Put (spans, failure) of every row into ``out`` by place; whether any failed. A
        frame of several rows that is ``bad`` is known to fail as a whole."""
        if not bad or len(frame) == 1:
            try:
                found = tried(frame.copy())
                out.update((p, (found.get(p, []), None)) for p in frame["doc_id"].tolist())
                return False
            except Exception as failure:  # noqa: BLE001  whatever a user's code raises
                if len(frame) == 1:
                    out[int(frame["doc_id"].iloc[0])] = None, f"{type(failure).__name__}: {failure}"[:500]
                    return True
        half = len(frame) // 2
        first = judged(frame.iloc[:half], False, out)
        return judged(frame.iloc[half:], not first, out) or first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
            own = own[own["text"].notna()]
            out: dict[int, tuple] = {}
            if len(own):
                judged(own, False, out)
            spans = [out.get(p, ([], None))[0] for p in range(len(texts))]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([s is not None for s in spans]), pa.array([s or [] for s in spans], span_type), pa.array([out.get(p, ([], None))[1] for p in range(len(texts))], pa.string()),
            ], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    span_type = to_arrow_type(schema["spans"].dataType)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def register_detector(docs: DataFrame, detector: Callable, order: int = 0) -> tuple[DataFrame, DataFrame]:
    """Spans of a user's detector (``with_detector``), and the documents (doc_id, error,
    failure) on which it failed, which have no spans."""
    judged = with_detector(docs, detector)
    found = judged.where("ok").select("doc_id", "text", F.explode("spans").alias("s"))
    value = F.substring("text", F.col("s.start_at") + 1, F.col("s.end_at") - F.col("s.start_at"))
    found = found.select("doc_id", "s.entity_type", value.alias("value"), "s.start_at", "s.end_at", "s.score", "s.source", F.lit(order).alias("detector_order"))
    return found, judged.where("not ok").select("doc_id", F.lit("MODELS_NOT_READY").alias("error"), "failure")


def validate_rules(rules: DataFrame) -> DataFrame:
    """(rule_id, error): null where a rule is valid. Expressions alone, in the table's own
    partitions; a pattern is compiled where its row is."""
    pattern, regex = F.col("pattern"), F.col("kind") == "regex"
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit("")) == ""
    lines = F.filter(F.transform(F.split(pattern, r"\r?\n"), lambda t: F.trim(F.regexp_replace(t, r"(?U)\s+", " "))), lambda t: t != "")
    # whether the pattern matches the empty text, as text; null where it does not compile
    matched = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), F.concat(F.lit("(?Ud)"), pattern), F.lit(""))
    error = (
        F.when(blank(F.col("name")) | blank(F.col("entity_type")) | (F.coalesce(F.length(pattern), F.lit(0)) == 0), "BLANK")
        .when(F.octet_length(pattern) > MOST_RULE_BYTES, "TOO_LONG")
        .when((F.col("kind") == "dictionary") & ~F.size(lines).between(1, MOST_TERMS), "TERMS")
        .when(regex & pattern.rlike(REFUSED), "REFUSED_CONSTRUCT")
        .when(regex & matched.isNull(), "DOES_NOT_COMPILE")
        .when(regex & (matched == "true"), "MATCHES_EMPTY")
    )
    return rules.select("rule_id", error.alias("error"))


def chunk_text(docs: DataFrame, stride: int = 400, width: int = 450) -> DataFrame:
    """Overlapping windows: (doc_id, chunk, base_at, text), cut from a text in one walk.
    Null and empty texts have none."""
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("chunk int, base_at int, text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py() or ""
                for lo in range(0, len(text), stride * CHUNKS_AT_ONCE):
                    starts = range(lo, min(len(text), lo + stride * CHUNKS_AT_ONCE), stride)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").take(pa.array([i] * len(starts))), pa.array([at // stride for at in starts], pa.int32()),
                        pa.array(list(starts), pa.int32()), pa.array([text[at : at + width] for at in starts]),
                    ], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def merge_chunk_spans(spans: DataFrame) -> DataFrame:
    """Chunk-local spans (doc_id, chunk, base_at, entity_type, start_at, end_at, score) in
    document offsets, each (type, start, end) once, from the earliest chunk, of which the
    highest score counts."""
    shifted = spans.withColumn("start_at", F.col("start_at") + F.col("base_at")).withColumn("end_at", F.col("end_at") + F.col("base_at"))
    first = F.min_by(F.struct("score", "chunk"), F.struct("chunk", -F.col("score"))).alias("f")
    return shifted.groupBy("doc_id", "entity_type", "start_at", "end_at").agg(first).select("doc_id", "entity_type", "start_at", "end_at", "f.score", "f.chunk")
