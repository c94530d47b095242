"""Review decisions, rules, policies and regions kept as tables (rewritten by joins)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from desense.functions.geometry import valid_region
from desense.functions.replacement import FIXED, GENERIC
from desense.operators.redact import resolve_replacement

MOST_REPLACEMENT_BYTES = 4096
#: Hits of one text on a page that are compared with each region; of more only those near it.
FEW_HITS = 64
#: Pairs that leave a task at a time.
PAIRS_AT_ONCE = 1 << 16
BUILT_IN_TYPES = [*FIXED, "ORGANIZATION", "PHONE", "ID_CARD", "BANK_CARD"]


def _reviewed(spans: DataFrame | None, decisions: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Spans (kind 0), decisions (1) and reviews (2) as rows of one table, brought together
    by document once, each row with what its document and its entity have: _error of the
    document's decisions (null where it has none, or they are good), _asked whether it has
    any, and of the one decision of the entity _sel and _rep, where it is good.

    One exchange: both windows keep to a document, which the rows are dealt by."""
    nothing = F.lit(None)
    as_rows = lambda df, kind, s, r, d: df.select("doc_id", (F.col("entity_id") if kind < 2 else nothing.cast("string")).alias("entity_id"), F.lit(kind).alias("_kind"), s.alias("_s"), d.alias("_d"), r.alias("_r"))
    whole = lambda df: F.struct(*df.columns)
    span_type = F.lit(None).cast(spans.select(whole(spans).alias("s")).schema["s"].dataType)
    review_type = nothing.cast("struct<state:string>") if reviews is None else nothing.cast(reviews.select(whole(reviews).alias("r")).schema["r"].dataType)
    kind = decisions.select(F.struct("selected", "replacement").alias("d")).schema["d"].dataType
    rows = as_rows(spans, 0, whole(spans), review_type, nothing.cast(kind))
    rows = rows.unionByName(as_rows(decisions, 1, span_type, review_type, F.struct("selected", "replacement")))
    if reviews is not None:
        rows = rows.unionByName(as_rows(reviews, 2, span_type, whole(reviews), nothing.cast(kind)))
    rows = rows.repartition("doc_id")
    entity, doc = Window.partitionBy("doc_id", "entity_id"), Window.partitionBy("doc_id")
    decided = F.col("_kind") == 1
    known = F.col("doc_id").isNotNull() & F.col("entity_id").isNotNull()
    rows = rows.select(
        "*", F.count_if(decided).over(entity).alias("_n"), (known & (F.count_if(F.col("_kind") == 0).over(entity) > 0)).alias("_known"),
        F.max(F.when(decided, F.struct("_d.selected", "_d.replacement"))).over(entity).alias("_own"),
    )
    wrong = F.when(F.col("_n") > 1, "DUPLICATE").when(~F.col("_known"), "FOREIGN").when(F.octet_length("_d.replacement") > MOST_REPLACEMENT_BYTES, "TOO_LONG")
    rows = rows.select("*", F.max(decided).over(doc).alias("_asked"), F.min(F.when(decided, wrong)).over(doc).alias("_error"))
    if reviews is not None:
        state = F.max(F.when(F.col("doc_id").isNotNull(), F.col("_r.state"))).over(doc)
        closed = F.when(state.isNull(), "TASK_MISSING").when(state != "awaiting_review", "INVALID_TASK_STATE")
        rows = rows.withColumn("_error", F.when(F.col("_asked"), F.coalesce(closed, "_error")))
    good = F.col("_known") & (F.col("_n") == 1) & F.col("_error").isNull()
    return rows.select("doc_id", "_kind", "_s", "_r", "_asked", "_error", good.alias("_good"), F.col("_own.selected").alias("_sel"), F.col("_own.replacement").alias("_rep"))


def _decided(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The spans of ``_reviewed`` rows, with decided: whether a good decision is theirs."""
    pick = lambda new, old: F.when(F.col("_good"), F.col(new)).otherwise(F.col(f"_s.{old}")).alias(old)
    new = {"selected": pick("_sel", "selected"), "replacement": pick("_rep", "replacement")}
    return rows.where("_kind = 0").select(*[new.get(c, F.col(f"_s.{c}")) for c in columns], F.col("_good").alias("decided"))


def _errors(rows: DataFrame) -> DataFrame:
    return rows.where("_asked and _error is not null").groupBy("doc_id").agg(F.first("_error").alias("error"))


def decision_errors(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """(doc_id, error) of documents whose decisions are refused: an id twice, an id that is
    not the document's, or a replacement over 4096 bytes."""
    return _errors(_reviewed(spans.select("doc_id", "entity_id"), decisions))


def decided_spans(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """As ``apply_decisions``, with decided: whether a decision set the span."""
    return _decided(_reviewed(spans, decisions), spans.columns)


def apply_decisions(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Spans with selected and replacement after review. A matched decision sets both, so a
    null replacement clears an earlier one; refused documents keep what they had."""
    return decided_spans(spans, decisions).drop("decided")


def propagate_to_regions(regions: DataFrame, decided: DataFrame, policies: DataFrame) -> DataFrame:
    """Regions (doc_id, region_id, entity_id, selected, replacement) linked to an entity that
    was decided take its decision and what it is replaced with: its own replacement, its
    type's policy or the default. All other regions, those marked by hand too, stay.
    ``decided`` is (doc_id, entity_id, entity_type, value, selected, replacement)."""
    e = resolve_replacement(decided, policies).select("doc_id", "entity_id", F.col("selected").alias("_sel"), F.col("replacement").alias("_rep"), F.lit(True).alias("_hit"))
    rows = regions.join(e, ["doc_id", "entity_id"], "left")
    pick = lambda new, old: F.when(F.col("_hit"), F.col(new)).otherwise(F.col(old)).alias(old)
    return rows.select("doc_id", "region_id", pick("_sel", "selected"), pick("_rep", "replacement"))


def upsert_policies(policies: DataFrame, edits: DataFrame) -> DataFrame:
    """Insert or overwrite by type; the last edit (by seq) wins, refused ones are ignored."""
    good = edits.where((F.trim("entity_type") != "") & (F.octet_length("replacement") <= MOST_REPLACEMENT_BYTES))
    last = good.groupBy("entity_type").agg(F.max_by("replacement", "seq").alias("new"))
    return policies.join(last, "entity_type", "full").select("entity_type", F.coalesce("new", "replacement").alias("replacement"))


def save_rules(rules: DataFrame, policies: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules upserted by id, and policies with a default for new types, never overwritten."""
    kept = rules.join(edits, "rule_id", "left_anti").unionByName(edits)
    new = edits.where(~F.col("entity_type").isin(BUILT_IN_TYPES)).select("entity_type").distinct().join(policies, "entity_type", "left_anti")
    return kept, policies.unionByName(new.withColumn("replacement", F.lit(GENERIC)))


def delete_rules(rules: DataFrame, ids: DataFrame) -> DataFrame:
    return rules.join(ids, "rule_id", "left_anti")


def revision_check(tasks: DataFrame, edits: DataFrame) -> DataFrame:
    """(task_id, revision, output_valid, error) for edits (task_id, expected): a right guess
    bumps the revision and drops the output, a wrong one is a conflict."""
    rows = edits.join(tasks.select("task_id", "revision"), "task_id", "left")
    ok = F.col("expected") == F.col("revision")
    error = F.when(F.col("revision").isNull(), "TASK_MISSING").when(~ok, "REVISION_CONFLICT")
    return rows.select("task_id", F.when(ok, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), (~F.coalesce(ok, F.lit(False))).alias("output_valid"), error.alias("error"))


def saved(reviews: DataFrame, changed: DataFrame) -> DataFrame:
    """Reviews (doc_id, state, revision, reviewed_revision, page_count, output_valid) after
    the documents ``changed`` (doc_id) were saved: the revision goes up and is the reviewed
    one, and the stored output no longer counts."""
    hit = changed.select("doc_id").distinct().withColumn("_hit", F.lit(True))
    return _after_save(reviews.join(hit, "doc_id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))))


def _after_save(rows: DataFrame) -> DataFrame:
    now = F.when(F.col("_hit"), F.col("revision") + 1).otherwise(F.col("revision")).cast("int")
    rows = rows.withColumn("revision", now).withColumn("reviewed_revision", F.when(F.col("_hit"), F.col("revision")).otherwise(F.col("reviewed_revision")))
    return rows.withColumn("output_valid", F.col("output_valid") & ~F.col("_hit")).drop("_hit")


def save_decisions(spans: DataFrame, decisions: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans and reviews after decisions, and (doc_id, error) of documents whose decisions
    are refused, all of them: no such task, not awaiting review, or ``decision_errors``."""
    rows = _reviewed(spans, decisions, reviews)
    hit = F.coalesce(F.col("_asked") & F.col("_error").isNull() & F.col("doc_id").isNotNull(), F.lit(False))
    after = _after_save(rows.where("_kind = 2").select("_r.*", hit.alias("_hit")))
    return _decided(rows, spans.columns).drop("decided"), after, _errors(rows)


def _judged_edits(edits: DataFrame, reviews: DataFrame) -> DataFrame:
    """Edits (doc_id, expected, ..) with page_count, and an error: no such task, not awaiting
    review, or at another revision than expected. Edits of a document are one change."""
    rows = edits.join(reviews.select("doc_id", "state", "revision", "page_count"), "doc_id", "left")
    error = F.when(F.col("state").isNull(), "TASK_MISSING").when(F.col("state") != "awaiting_review", "INVALID_TASK_STATE").when(F.col("expected") != F.col("revision"), "REVISION_CONFLICT")
    return rows.withColumn("error", error).drop("state", "revision")


def _but_for(regions: DataFrame, changed: DataFrame) -> DataFrame:
    """Regions without the changed ones. An anti join would be moved to before regions were
    dealt out, by whoever passes them in many parts, and be done in few."""
    hit = changed.select("doc_id", "region_id", F.lit(True).alias("_hit"))
    return regions.join(hit, ["doc_id", "region_id"], "left").where("_hit is null").drop("_hit")


def upsert_regions(regions: DataFrame, edits: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions (doc_id, region_id, page, source, text, polygon) after edits (the same without
    source, and expected), whose source is manual; the reviews saved; and the refused edits
    (doc_id, region_id, error), those of invalid regions too."""
    rows = _judged_edits(edits, reviews)
    valid = F.coalesce(valid_region(F.col("polygon"), F.col("page"), F.col("page_count")), F.lit(False))
    rows = rows.withColumn("error", F.when(F.col("error").isNull() & ~valid, "INVALID_REGION").otherwise(F.col("error")))
    good = rows.where("error is null")
    columns = ["doc_id", "region_id", "page", "source", "text", "polygon"]
    kept = _but_for(regions.select(*columns), good).select(*columns)
    new = good.withColumn("source", F.lit("manual")).select(*columns)
    return kept.unionByName(new), saved(reviews, good), rows.where("error is not null").select("doc_id", "region_id", "error")


def remove_regions(regions: DataFrame, removals: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions without the removed manual ones (doc_id, region_id, expected), the reviews
    saved, and the refused removals; a region that is missing or not manual is one."""
    rows = _judged_edits(removals, reviews).join(regions.select("doc_id", "region_id", "source"), ["doc_id", "region_id"], "left")
    lost = F.when(F.col("source").isNull(), "MISSING").when(F.col("source") != "manual", "NOT_MANUAL")
    rows = rows.withColumn("error", F.coalesce("error", lost))
    good = rows.where("error is null")
    left = _but_for(regions, good)
    return left, saved(reviews, good), rows.where("error is not null").select("doc_id", "region_id", "error")


class _Lines:
    """Lines of one document that began, but for those that another with a smaller number
    outlasts: their numbers rise, and so do their ends."""

    def __init__(self):
        self.numbers: list[int] = []
        self.ends: list[int] = []

    def add(self, number: int, end: int) -> None:
        at = bisect_left(self.numbers, number)
        if at and self.ends[at - 1] >= end:
            return
        upto = max(at, bisect_right(self.ends, end))
        self.numbers[at:upto], self.ends[at:upto] = [number], [end]

    def first(self, end: int) -> int | None:
        """The smallest number of those that last until ``end``."""
        at = bisect_left(self.ends, end)
        return self.numbers[at] if at < len(self.ends) else None


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines and entities sorted by document and start, lines first, the entities with
    their line."""
    doc, lines = None, _Lines()
    for batch in batches:
        found, rows = [], []
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "_kind", "start_at", "end_at", "line_no")]
        for i, (d, kind, _, end, number) in enumerate(zip(*columns, strict=True)):
            if d != doc:
                doc, lines = d, _Lines()
            if kind == 0:
                lines.add(number, end)
            else:
                rows.append(i)
                found.append(lines.first(end))
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("entity_id").take(at), pa.array(found, pa.int32())], names=["doc_id", "entity_id", "line_no"])


def first_line_of(entities: DataFrame, lines: DataFrame) -> DataFrame:
    """Each entity with the first line that holds it fully, null where none does. One sweep
    over both by document and start, which never pairs them; an entity with a null end or
    document has none."""
    marks = lines.select("doc_id", F.lit(0).alias("_kind"), "start_at", "end_at", F.col("line_no").cast("int").alias("line_no"), F.lit(None).cast(entities.schema["entity_id"].dataType).alias("entity_id"))
    marks = marks.where("doc_id is not null and start_at is not null and end_at is not null and line_no is not null")
    own = entities.select("doc_id", F.lit(1).alias("_kind"), "start_at", "end_at", F.lit(None).cast("int").alias("line_no"), "entity_id")
    placed = F.col("doc_id").isNotNull() & F.col("start_at").isNotNull() & F.col("end_at").isNotNull()
    rows = marks.unionByName(own.where(placed)).repartition("doc_id").sortWithinPartitions("doc_id", "start_at", "_kind")
    schema = StructType([entities.schema["doc_id"], entities.schema["entity_id"], StructField("line_no", IntegerType())])
    return rows.mapInArrow(_swept, schema).unionByName(own.where(~placed).select("doc_id", "entity_id", "line_no"))


def _near(b: list[np.ndarray], own: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows ``own`` (regions) and hits whose boxes ``b`` touch; the hits of a region
    are ``count`` rows from ``first`` on."""
    few = count <= FEW_HITS
    r = np.repeat(own[few], count[few])
    h = np.repeat(first[few], count[few]) + np.arange(len(r)) - np.repeat(np.cumsum(count[few]) - count[few], count[few])
    left, right = [r], [h]
    for at in np.unique(first[~few]).tolist():
        mine = ~few & (first == at)
        hits = np.arange(at, at + count[mine][0])
        hits = hits[np.argsort(b[0][hits], kind="stable")]
        x, wide = b[0][hits], max(float((b[2][hits] - b[0][hits]).max()), 0.0)
        # a little more than what touches, as the difference is rounded
        los = np.searchsorted(x, b[0][own[mine]] - wide - 1e-6, side="left")
        his = np.searchsorted(x, b[2][own[mine]], side="right")
        for i, lo, hi in zip(own[mine].tolist(), los.tolist(), his.tolist(), strict=True):
            close = hits[lo:hi]
            close = close[(b[2][close] >= b[0][i]) & (b[1][close] <= b[3][i]) & (b[3][close] >= b[1][i])]
            left.append(np.full(len(close), i))
            right.append(close)
    r, h = np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64)
    met = (b[0][h] <= b[2][r]) & (b[2][h] >= b[0][r]) & (b[1][h] <= b[3][r]) & (b[3][h] >= b[1][r])
    return r[met], h[met]


def best_hit(regions: DataFrame, hits: DataFrame, iou: Column, region_box: tuple, hit_box: tuple) -> DataFrame:
    """For each region the hit of its text on its page with the greatest overlap ratio; ties
    take the last hit; without any overlap, or for a region without text, the region itself
    (hit_id null).

    ``region_box`` and ``hit_box`` are columns (x0, y0, x1, y1) in parts of a page. Regions and
    hits come together by document once, each row once, and are walked over by page and text,
    hits first; a task holds the hits of one text on one page. Where these are many, they are
    sorted by place, and what lies apart does not meet.
    """
    key = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    placed = lambda box: box[0].isNotNull() & box[1].isNotNull() & box[2].isNotNull() & box[3].isNotNull()
    own = regions.withColumn("_text", F.when(key != "", key)).withColumn("_kind", F.lit(1)).drop("text")
    found = hits.withColumn("_text", key).where((F.col("_text") != "") & F.col("doc_id").isNotNull() & F.col("page").isNotNull() & placed(hit_box)).withColumn("_kind", F.lit(0)).drop("text")
    common = ["doc_id", "page", "_text", "_kind"]
    of_region, of_hit = ([c for c in df.columns if c not in common] for df in (own, found))
    rows = own.unionByName(found, allowMissingColumns=True).repartition("doc_id").sortWithinPartitions(*common)
    rows = rows.withColumns({f"_b{i}": F.when(F.col("_kind") == 0, hit_box[i]).otherwise(region_box[i]).cast("double") for i in range(4)})
    kept = ["doc_id", "page", *of_region]
    schema = StructType([*(StructField(f.name, f.dataType) for f in (own.schema[c] for c in kept)), *(StructField(c, found.schema[c].dataType) for c in of_hit), StructField("_n", LongType())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every region with each hit near it, or with none, numbered."""
        held, seen = None, 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
            n = len(rows)
            if not n:
                continue
            new = np.ones(n, bool)
            same = np.ones(n - 1, bool)
            for c in common[:3]:
                column = rows.column(c)
                same &= pc.fill_null(pc.equal(column.slice(1), column.slice(0, n - 1)), False).to_numpy()
            new[1:] = ~same
            group, begins = np.cumsum(new) - 1, np.flatnonzero(new)
            kind = rows.column("_kind").to_numpy()
            count = np.bincount(group, weights=kind == 0, minlength=len(begins)).astype(np.int64)
            own = np.flatnonzero(kind == 1)
            b = [rows.column(f"_b{i}").to_numpy() for i in range(4)]
            r, h = _near(b, own, begins[group[own]], count[group[own]])
            alone = np.setdiff1d(own, r)
            r, h = np.concatenate([r, alone]), np.concatenate([h, np.full(len(alone), -1)])
            order = np.argsort(r, kind="stable")
            for at in range(0, len(r), PAIRS_AT_ONCE):
                r_at, h_at = r[order[at : at + PAIRS_AT_ONCE]], h[order[at : at + PAIRS_AT_ONCE]]
                left, right = rows.select(kept).take(pa.array(r_at)), rows.select(of_hit).take(pa.array(h_at, mask=h_at < 0))
                yield from pa.Table.from_arrays([*left.columns, *right.columns, pa.chunked_array([pa.array(r_at + seen)])], names=schema.names).combine_chunks().to_batches()
            seen += n
            held = rows.slice(int(begins[-1]), int(count[-1])) if count[-1] else None

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the rows of each region, which follow each other, the best."""
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
            if not len(rows):
                continue
            order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("_n", "ratio", "hit_id")], null_placement="at_start").to_numpy()
            number = rows.column("_n").to_numpy()[order]
            last = order[np.append(number[1:] != number[:-1], True)]
            held = rows.take(pa.array(last[-1:]))
            yield from rows.take(pa.array(last[:-1])).select(out.names).combine_chunks().to_batches()
        if held is not None:
            yield from held.select(out.names).to_batches()

    pairs = rows.mapInArrow(meet, schema).withColumn("ratio", iou.cast(DoubleType()))
    good = lambda c: F.when(F.col("ratio") > 0, F.col(c)).alias(c)
    out = StructType([StructField(c, schema[c].dataType) for c in ("doc_id", "page", "region_id", "hit_id")])
    return pairs.select("_n", "doc_id", "page", "region_id", good("hit_id"), good("ratio")).mapInArrow(best, out)


def reading_order(lines: DataFrame) -> DataFrame:
    """Place of each line on its page: row bands by centre height (a new band where the
    centre falls by more than half the smaller height), then left to right."""
    by_y = Window.partitionBy("doc_id", "page").orderBy("cy", "x0", "line_id")
    rows = lines.withColumn("cy", (F.col("y0") + F.col("y1")) / 2).withColumn("h", F.col("y1") - F.col("y0"))
    new = F.col("cy") - F.lag("cy").over(by_y) > F.least("h", F.lag("h").over(by_y)) / 2
    rows = rows.withColumn("_new", F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("band", F.sum("_new").over(by_y.rowsBetween(Window.unboundedPreceding, 0)))
    order = Window.partitionBy("doc_id", "page").orderBy("band", "x0", "line_id")
    return rows.withColumn("place", F.row_number().over(order)).drop("_new")


def assemble_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, start_at, end_at) of the lines in the document's text; a newline
    goes before a line unless the text is empty or already ends with one."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    # the last character so far is that of the last line with any text
    tail = F.last(F.when(F.length("text") > 0, F.right(F.col("text"), F.lit(1))), ignorenulls=True).over(upto)
    filled = F.coalesce(F.sum(F.length("text")).over(upto), F.lit(0)) > 0
    rows = lines.withColumn("_sep", F.when(filled & (tail != "\n"), 1).otherwise(0))
    end = F.sum(F.length("text") + F.col("_sep")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("doc_id", "line_no", (end - F.length("text")).cast("int").alias("start_at"), end.cast("int").alias("end_at"))
