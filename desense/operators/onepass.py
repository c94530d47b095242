"""Detection, conflict resolution and redaction of a text in one pass over its row.

The engine's own expressions find the matches of every pattern; small Arrow functions
inside the tasks turn them into places, look up dictionary terms, choose among overlapping
spans and write the redacted text, each in time about linear in the text and its matches.
Nothing is shuffled, so all of it works on streams as on tables.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from desense.functions.linear import marked
from desense.functions.matching import cut, lengths
from desense.functions.replacement import default_of

MOST_TEXT_BYTES, MOST_SPANS = 8 * 1024 * 1024, 100_000
#: Least score of a span that is redacted without a reviewer's say.
SELECTED = 0.3
#: Rows, and bytes of their texts, that a task turns into Python objects at a time.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1024, 1 << 20
#: Terms that expressions look for before a text goes to Python.
MOST_SOUGHT = 32
#: A span inside a task: these fields in this order.
FIELDS = ["entity_type", "value", "start_at", "end_at", "score", "source", "detector_order"]
SPANS = "array<struct<entity_type:string,value:string,start_at:int,end_at:int,score:double,source:string,detector_order:int>>"


@dataclass(frozen=True)
class Pattern:
    """A regular expression whose matches are spans."""

    entity_type: str
    regex: str
    score: float
    source: str
    order: int
    beside_digits: bool = True
    #: A text that every match holds, if there is one: it is looked for first.
    holds: str = ""
    #: The same for ``linear.marked``, where that has to search; every text goes to Python.
    linear: str | None = None


@dataclass(frozen=True)
class Term:
    """A literal text whose occurrences are spans; those of one term don't overlap."""

    entity_type: str
    term: str
    source: str
    order: int


def runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """A batch's rows in runs (first, number) of bounded size; a text beyond it is alone."""
    first, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > first and (i - first == ROWS_AT_ONCE or held + size > BYTES_AT_ONCE):
            yield first, i - first
            first, held = i, 0
        held += size
    if len(texts) > first:
        yield first, len(texts) - first


def matches(text: str, turns: list[int], p: Pattern) -> Iterator[tuple]:
    """Spans of one pattern from how many code points its matches and what is between have."""
    at = 0
    for gap, size in zip(turns[::2], turns[1::2], strict=False):
        start = at + gap
        at = start + size
        if size and (p.beside_digits or not ((start and text[start - 1] in "0123456789") or (at < len(text) and text[at] in "0123456789"))):
            yield p.entity_type, text[start:at], start, at, p.score, p.source, p.order


class TermFinder:
    """All occurrences of many terms in one walk over a text."""

    def __init__(self, terms: list[Term]):
        import ahocorasick

        self.of: dict[str, list[Term]] = {}
        for t in terms:
            if t.term:
                self.of.setdefault(t.term, []).append(t)
        self.walk = ahocorasick.Automaton()
        for word in self.of:
            self.walk.add_word(word, word)
        if self.of:
            self.walk.make_automaton()

    def spans(self, text: str) -> Iterator[tuple]:
        ends: dict[str, int] = {}
        for last, word in self.walk.iter(text) if self.of else ():
            start = last + 1 - len(word)
            if start >= ends.get(word, 0):
                ends[word] = last + 1
                for t in self.of[word]:
                    yield t.entity_type, word, start, last + 1, 1.0, t.source, t.order


def priority(span: tuple) -> tuple:
    """Score and bytes descending, then start, type and detector ascending."""
    return -span[4], -len(span[1].encode("utf-8", "surrogatepass")), span[2], span[0], span[6]


def disjoint(order: Iterable[int], start: list[int], end: list[int]) -> list[int]:
    """Of ranges in the given order those that overlap none taken before."""
    starts: list[int] = []
    taken: list[int] = []
    for i in order:
        at = bisect_right(starts, start[i])
        if not (at and end[taken[at - 1]] > start[i]) and not (at < len(starts) and starts[at] < end[i]):
            starts.insert(at, start[i])
            taken.insert(at, i)
    return taken


def without_overlaps(spans: list[tuple]) -> list[tuple]:
    """Spans by priority, each if it overlaps none taken; in the order of the text. Equal
    spans of one detector are one."""
    spans = sorted(set(spans), key=lambda s: (s[2], s[3]))
    if all(a[3] <= b[2] for a, b in zip(spans, spans[1:], strict=False)):
        return spans
    order = sorted(range(len(spans)), key=lambda i: priority(spans[i]))
    return [spans[i] for i in disjoint(order, [s[2] for s in spans], [s[3] for s in spans])]


def _by_row(column: pa.ListArray) -> list[list[int]]:
    """Lists of numbers, an empty one for null."""
    at = column.offsets.to_numpy()
    own = column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).tolist()
    ends = (at - at[0]).tolist()
    return [own[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def sought(docs: DataFrame, patterns: list[Pattern], terms: list[Term], more: Column | None = None) -> tuple[DataFrame, list[str], Callable]:
    """``docs`` with ``_touched``, whether Python has to see the text, and columns that say
    where the patterns match; the names of these; and a function that gives, inside a task,
    each text's spans in order of the detectors (None for null) from texts and these columns.

    A text is touched if it has a match of some pattern, one of the terms (where there are
    few: of many, any text may have one), or where ``more`` says so.
    """
    all_patterns, patterns = patterns, [p for p in patterns if p.linear is None]
    searched = [p for p in all_patterns if p.linear is not None]
    distinct = {t.term for t in terms if t.term}
    names = [f"_p{i}" for i in range(len(patterns))]
    rows = docs.select("*", *[cut(F.col("text"), p.regex, p.holds).alias(n) for n, p in zip(names, patterns, strict=True)])
    rows = rows.select(*docs.columns, *[lengths(F.col(n)).alias(n) for n in names])
    asked = [F.col(n).isNotNull() for n in names]
    asked += [F.lit(True)] if searched or len(distinct) > MOST_SOUGHT else [F.contains("text", F.lit(t)) for t in sorted(distinct)]
    touched = F.lit(False)
    for a in asked if more is None else [more, *asked]:
        touched = touched | F.coalesce(a, F.lit(False))
    finder: list[TermFinder] = []

    def spans_of(texts: pa.Array, columns: list[pa.Array]) -> Iterator[list[tuple] | None]:
        if not finder:
            finder.append(TermFinder(terms))
        own = [*zip(patterns, map(_by_row, columns), strict=True)]
        own += [(p, [[*map(len, parts)] for parts in marked(texts, p.linear)]) for p in searched]
        for i, text in enumerate(texts.to_pylist()):
            if text is None:
                yield None
                continue
            spans = [s for p, turns in own if turns[i] for s in matches(text, turns[i], p)]
            spans += finder[0].spans(text)
            yield spans

    return rows.withColumn("_touched", touched), names, spans_of


def scanned(docs: DataFrame, patterns: list[Pattern], terms: list[Term], finish: Callable[[str, list[tuple], dict], object], made: Callable[[list, pa.DataType], pa.Array], kind: str, empty: Column, carry: list[str] = (), more: Column | None = None) -> DataFrame:
    """``docs`` with one more column ``found`` of type ``kind``: what ``finish`` makes of a
    text, its spans in order of the detectors and the ``carry`` columns of the row, put in a
    column by ``made``. Rows without a text have null. A task makes Python objects of a
    bounded part of a batch at a time.

    A text goes to Python only if it is touched (``sought``); all others are ``empty``. Of
    the rows only what is asked for goes there, never other columns.
    """
    rows, names, spans_of = sought(docs, patterns, terms, more)

    @F.arrow_udf(kind)
    def found(texts: pa.Array, *columns: pa.Array) -> pa.Array:
        parts = [part(texts.slice(at, n), [c.slice(at, n) for c in columns]) for at, n in runs(texts)]
        return pa.concat_arrays(parts) if parts else made([], arrow)

    def part(texts: pa.Array, columns: list[pa.Array]) -> pa.Array:
        carried = {c: v.to_pylist() for c, v in zip(carry, columns[len(names) :], strict=True)}
        out = []
        for i, (text, spans) in enumerate(zip(texts.to_pylist(), spans_of(texts, columns[: len(names)]), strict=True)):
            out.append(None if spans is None else finish(text, spans, {c: v[i] for c, v in carried.items()}))
        return made(out, arrow)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(StructType.fromDDL(f"found {kind}")["found"].dataType)
    result = found(F.when(F.col("_touched"), F.col("text")), *names, *carry)
    return rows.withColumn("found", F.when(F.col("text").isNotNull(), F.when(F.col("_touched"), result).otherwise(empty.cast(kind)))).drop("_touched", *names)


def _lists(rows: list[list[tuple] | None], kind: pa.DataType) -> pa.Array:
    """The spans of each row, column by column; null where there is no text."""
    flat = [s for spans in rows for s in spans or ()]
    columns = zip(*flat, strict=True) if flat else [()] * len(FIELDS)
    fields = list(kind.value_type)
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    ends = np.cumsum([0, *(len(spans or ()) for spans in rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs, type=kind, mask=pa.array([spans is None for spans in rows], pa.bool_()))


def _outcomes(rows: list[tuple | None], kind: pa.DataType) -> pa.Array:
    """Tuples of the fields of ``kind``, whose first may be spans; null where there is no text."""
    fields = list(kind)
    columns = [[r[i] if r else None for r in rows] for i in range(len(fields))]
    arrays = [_lists(c, f.type) if pa.types.is_list(f.type) else pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]
    return pa.StructArray.from_arrays(arrays, fields=fields, mask=pa.array([r is None for r in rows], pa.bool_()))


def all_spans(docs: DataFrame, patterns: list[Pattern], terms: list[Term]) -> DataFrame:
    """(doc_id, entity_type, value, start_at, end_at, score, source, detector_order) of every
    span, before conflicts are resolved. They leave a task as rows, those of many texts
    together."""
    rows, names, spans_of = sought(docs.select("doc_id", "text"), patterns, terms)
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("entity_type string, value string, start_at int, end_at int, score double, source string, detector_order int").fields])
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in runs(batch.column("text")):
                part = batch.slice(first, n)
                of, flat = [], []
                for i, spans in enumerate(spans_of(part.column("text"), part.columns[2:])):
                    own = dict.fromkeys(spans or ())
                    of += [i] * len(own)
                    flat += own
                if flat:
                    made = [pa.array(c, t) for c, t in zip(zip(*flat, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), *made], names=schema.names)

    # a filter would be pushed below the columns, which searches every text again
    return rows.select("doc_id", F.when(F.col("_touched"), F.col("text")).alias("text"), *names).mapInArrow(run, schema)


def kept_spans(docs: DataFrame, patterns: list[Pattern], terms: list[Term], most_spans: int = MOST_SPANS, annotated: bool = False, listed: bool = False, policies: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with found: a struct of the selected spans, which don't overlap, and an error.
    A span is selected after conflicts, if its score is at least ``SELECTED``. With
    ``policies``, found has instead the text with the spans replaced (redacted, null without
    any) and their number (n_spans): the text goes to Python once.

    With ``annotated``, docs have the columns ok and spans, of an annotation: a document
    whose annotation is missing or failed, or has a span outside the text, fails; else its
    spans come first among the candidates. With ``listed``, the column listed has spans that
    were found elsewhere (``SPANS``). A document fails too where rules add matches beyond
    ``most_spans`` spans. What fails has no spans.
    """

    def judged(text: str, spans: list[tuple], row: dict) -> tuple[list[tuple], str | None]:
        given: list[tuple] = []
        if annotated:
            for s in row["spans"] or []:
                if not 0 <= s["start_at"] < s["end_at"] <= len(text):
                    return [], "SPAN_OUTSIDE"
                given.append((s["entity_type"], text[s["start_at"] : s["end_at"]], s["start_at"], s["end_at"], s["score"], s["source"], 0))
        if listed:
            found = [tuple(s[f] for f in FIELDS) for s in row["listed"] or []]
            spans = spans + [s for s in found if text[s[2] : s[3]] == s[1]]
        by_rules = sum(s[6] >= 100 for s in spans)
        if by_rules and len(given) + len(spans) > most_spans:
            return [], "TOO_MANY_ENTITIES"
        valid = [s for s in given + spans if 0 <= s[4] <= 1]
        return [s for s in without_overlaps(valid) if s[4] >= SELECTED], None

    def written(text: str, spans: list[tuple], row: dict) -> tuple:
        kept, error = judged(text, spans, row)
        edits = [(s[2], s[3], policies[s[0]] if s[0] in policies else default_of(s[0], s[1])) for s in kept]
        return _applied(text, edits) if kept else None, len(kept), error

    none = F.lit(None).cast("string")
    if policies is None:
        finish, kind, first = judged, f"struct<spans:{SPANS},error:string>", [F.array().cast(SPANS).alias("spans")]
    else:
        finish, kind, first = written, "struct<redacted:string,n_spans:int,error:string>", [none.alias("redacted"), F.lit(0).alias("n_spans")]
    outcome = lambda error: F.struct(*first, error.alias("error")).cast(kind)
    carry = ["listed"] if listed else []
    more = F.size("listed") > 0 if listed else F.lit(False)
    if not annotated:
        return scanned(docs, patterns, terms, finish, _outcomes, kind, outcome(none), carry, more)
    ready = F.coalesce("ok", F.lit(False))
    rows = scanned(docs.withColumn("_whole", F.col("text")).withColumn("text", F.when(ready, F.col("text"))), patterns, terms, finish, _outcomes, kind, outcome(none), ["spans", *carry], F.coalesce(F.size("spans") > 0, F.lit(False)) | F.coalesce(more, F.lit(False)))
    failed = F.when(~ready & F.col("_whole").isNotNull(), outcome(F.lit("MODELS_NOT_READY"))).otherwise(F.col("found"))
    return rows.withColumn("found", failed).withColumn("text", F.col("_whole")).drop("_whole")


def _applied(text: str, edits: list[tuple]) -> str:
    """``text`` with sorted, disjoint (start_at, end_at, replacement) applied."""
    parts, at = [], 0
    for start, end, replacement in edits:
        parts += (text[at:start], replacement or "")
        at = end
    return "".join([*parts, text[at:]])


def edited(text: Column, edits: Column, has: Column | None = None) -> Column:
    """``text`` with sorted, disjoint edits (start_at, end_at, replacement) applied. Only
    texts that ``has`` edits of go to Python."""

    @F.arrow_udf(StringType())
    def apply(texts: pa.Array, changes: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.string())]
        for at, n in runs(texts):
            own, ends = changes.slice(at, n), changes.slice(at, n).offsets.to_pylist()
            edits = [*zip(*(c.to_pylist() for c in own.values.slice(ends[0], ends[-1] - ends[0]).flatten()), strict=True)]
            rows = zip(texts.slice(at, n).to_pylist(), ends, ends[1:], strict=False)
            parts.append(pa.array([_applied(t, edits[a - ends[0] : b - ends[0]]) if t is not None and a < b else t for t, a, b in rows], pa.string()))
        return pa.concat_arrays(parts)

    has = F.size(edits) > 0 if has is None else has
    return F.when(F.coalesce(has, F.lit(False)), apply(F.when(has, text), F.when(has, edits))).otherwise(text)


def redacted(docs: DataFrame, patterns: list[Pattern], terms: list[Term], policies: dict[str, str], most_spans: int = MOST_SPANS, annotated: bool = False, listed: bool = False) -> DataFrame:
    """(doc_id, redacted, n_spans, error) of every document: one scan, no shuffle. A text
    that is null, empty or over 8 MiB fails; what fails has no redacted text."""
    size = F.octet_length("text")
    rows = docs.withColumn("_refused", F.when(F.coalesce(size, F.lit(0)) == 0, "EMPTY_TEXT").when(size > MOST_TEXT_BYTES, "TEXT_TOO_LARGE"))
    rows = rows.withColumn("text", F.when(F.col("_refused").isNull(), F.col("text")))
    rows = kept_spans(rows, patterns, terms, most_spans, annotated, listed, policies)
    text = F.when(F.col("found.n_spans") > 0, F.col("found.redacted")).otherwise(F.col("text"))
    out = rows.select("doc_id", text.alias("redacted"), F.coalesce("found.n_spans", F.lit(0)).alias("n_spans"), F.coalesce("_refused", "found.error").alias("error"))
    return out.withColumn("redacted", F.when(F.col("error").isNull(), F.col("redacted")))
