"""What large tables need: nothing whole in the driver or in one task."""

from __future__ import annotations

import datetime
import hashlib
import random
import re

import pyarrow as pa
import pytest
from compare import SF_DIR
from pyspark.sql import functions as F

from desense.functions import geometry, replacement
from desense.operators import audit, detect, onepass, redact, review, spans, tasks
from desense.plans import registry
from desense.sources import inputs
from desense.streaming import jobs


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_and_terms_of_a_dictionary_are_not_broadcast(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("of Customer#"), F.col("id").cast("string")).alias("text"))
    terms = spark.range(50).select(F.lit("NAME").alias("entity_type"), F.concat(F.lit("Customer#"), F.col("id").cast("string")).alias("term"))
    assert "Broadcast" not in plan_of(detect.detect_terms(docs, terms))
    # a term that is longer than what goes with a place is compared with its text
    longer = terms.withColumn("term", F.concat("term", F.lit("x" * 200)))
    assert "Broadcast" not in plan_of(detect.detect_terms(docs, longer))
    many = spark.range(1001).select((F.col("id") + 1).cast("int").alias("rule_id"), F.lit("NAME").alias("entity_type"), F.lit("literal").alias("kind"), F.concat(F.lit("Customer#"), F.col("id").cast("string")).alias("pattern"), F.lit(True).alias("enabled"))
    policies = spark.createDataFrame([], "entity_type string, replacement string")
    assert "Broadcast" not in plan_of(redact.redact_texts(docs, many, policies))


def test_contacts_of_one_row_group_are_searched_by_all_cores(spark, tmp_path):
    import duckdb

    rows = "SELECT i AS c_custkey, 'Customer#' || lpad(i::VARCHAR, 9, '0') AS c_name, rpad('x', 4000, md5(i::VARCHAR)) AS c_mktsegment FROM range(20000) t(i)"
    duckdb.execute(f"COPY ({rows}) TO '{tmp_path}/customer.parquet' (ROW_GROUP_SIZE 1000000, COMPRESSION uncompressed)")
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # many parts of the file, one of which has the rows
    try:
        parts = inputs.load(spark, str(tmp_path), "contacts").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert len(parts) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in parts) == 20000


def test_a_detector_is_not_asked_what_is_known(spark):
    """Of sixteen rows with one that fails, a frame whose first half is good is not tried
    whole again in its second half."""
    calls = spark.sparkContext.accumulator(0)

    def detector(frames):
        import pandas as pd

        for f in frames:
            calls.add(1)
            if 15 in f["doc_id"].tolist():
                raise ValueError("no")
            yield pd.DataFrame({"doc_id": f["doc_id"], "entity_type": "A", "start_at": 0, "end_at": 1, "score": 1.0})

    docs = spark.range(16).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    rows = detect.with_detector(docs, detector).collect()
    assert [r.doc_id for r in rows if not r.ok] == [15] and sum(len(r.spans) for r in rows) == 15
    assert calls.value == 1 + 4 + 1  # the whole, the first half at each of four steps, and the row itself


def test_hits_and_regions_are_shuffled_once_each(spark):
    """No copies for cells of a page; batches cut groups anywhere."""
    rnd = random.Random(5)
    box = lambda: (x := rnd.random(), y := rnd.random(), x + rnd.random() / 3, y + rnd.random() / 3)
    hits = [(rnd.choice([1, 2, None]), rnd.choice([0, 1]), i, rnd.choice(["a", " a", "b", "", None]), *box()) for i in range(700)] + [(1, 0, 999, "a", None, 0.0, 1.0, 1.0)]
    regions = [(rnd.choice([1, 2, 3, None]), rnd.choice([0, 1]), i, rnd.choice(["a ", "b", "c", " ", None]), *box()) for i in range(300)] + [(1, 0, 999, "a", None, 0.0, 1.0, 1.0)]
    h = spark.createDataFrame(hits, "doc_id long, page int, hit_id int, text string, hx0 double, hy0 double, hx1 double, hy1 double")
    r = spark.createDataFrame(regions, "doc_id long, page int, region_id int, text string, x0 double, y0 double, x1 double, y1 double")
    boxes = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"h{c}") for c in ("x0", "y0", "x1", "y1"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = review.best_hit(r, h, geometry.overlap_ratio(*boxes), *boxes)
        assert "Generate" not in plan_of(found) and plan_of(found).count("Exchange") == 1
        got = {x.region_id: x.hit_id for x in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def ratio(a, b):
        w, t = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0), max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)
        return w * t / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * t)

    for d, page, i, text, *own in regions:
        best = max(((ratio(own, x[4:]), x[2]) for x in hits if d and None not in (own[0], x[4]) and x[:2] == (d, page) and text and text.strip() and (x[3] or "").strip() == text.strip()), default=(0, None))
        assert got[i] == (best[1] if best[0] > 0 else None)


def test_a_stream_calls_python_by_parts_of_its_keys(spark, tmp_path):
    """So many keys are few state rows; what was done leaves a row, what runs stays in it."""
    n = 3000
    start = datetime.datetime(2024, 1, 1)
    kept, was = {}, jobs.STATE_PARTS
    jobs.STATE_PARTS = 16

    def sink(rows, _):
        kept.update({r[0]: tuple(r)[1:] for r in rows.collect()})

    def run(make, path, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
        query = stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]

    try:
        big = 1 << 60  # keys that no double holds
        progress = lambda s: jobs.live_progress(s, "1 minute", "1 minute")
        schema = "batch_id long, idx int, state string, items long, ts timestamp"
        sizes = run(progress, tmp_path / "p", [(big + k, i, "completed" if k % 2 else "analyzing", 2, start) for k in range(n) for i in range(2)] + [(None, 0, "analyzing", 1, start)], schema)
        assert max(sizes) <= 16 and len(kept) == n + 1 and kept[big + 1] == (2, 2, 200) and kept[big] == (0, 2, 20) and kept[None] == (0, 1, 10)
        run(progress, tmp_path / "p", [(None, 0, "completed", 1, start + datetime.timedelta(hours=1))], schema)
        kept.clear()
        run(progress, tmp_path / "p", [(big + k, 0, "completed", 2, start + datetime.timedelta(hours=1, minutes=1)) for k in range(2)], schema)
        assert kept == {big: (1, 2, 110), big + 1: (1, 2, 100)}  # the second one was done and forgotten
        kept.clear()
        schema = "job_id long, state string, seq long, ts timestamp"
        sizes = run(lambda s: jobs.live_jobs(s), tmp_path / "j", [(big + k, s, i, start) for k in range(n) for i, s in enumerate(("queued", "failed"))], schema)
        assert max(sizes) <= 16 and len(kept) == n and kept[big + 7] == ("failed", 1, start)
    finally:
        jobs.STATE_PARTS = was


def test_rows_without_a_task_are_not_one_partition(spark):
    items = spark.range(4000).select((F.col("id") % 50).alias("batch_id"), F.col("id").alias("idx"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("task_id"), F.lit("failed").alias("state"))
    known = spark.range(0, 4000, 8).select(F.col("id").alias("task_id"), F.lit("completed").alias("state"), F.lit(1).alias("reviewed_revision"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        of = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        assert of(tasks.refresh_items(items, known))[-1] < 1500
        left = tasks.delete_tasks(known, known.select("task_id"), items)[1][0]
        assert of(left)[-1] < 1500 and left.count() == 3500 and sorted(left.columns) == sorted(items.columns)
        bare = tasks.delete_tasks(known, known.select("task_id"), items.select("task_id"))[1][0]
        assert of(bare)[-1] < 1500 and bare.count() == 3500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = tasks.refresh_items(items, known).groupBy("state", "error").count().collect()
    assert {(r.state, r.error): r["count"] for r in got} == {("completed", None): 500, ("failed", "TASK_MISSING"): 500, ("failed", None): 3000}


def test_hash_of_all_hashes_in_order(spark):
    texts = {"a": ["x", "y", "y", None], "b": ["y"], "c": [None], None: ["z", "w"]}
    rows = spark.createDataFrame([(s, 1, t) for s, ts in texts.items() for t in ts], "source string, mode int, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r.source: r.output_hash for r in audit.ordered_hash(rows, ["source", "mode"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    hashed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {s: hashed("".join(sorted(hashed(t) for t in ts if t is not None))) if any(ts) else None for s, ts in texts.items()}


def _given_to_python(monkeypatch, df, make):
    """What ``make`` gives to mapInArrow: all rows as one batch, and what comes out of it."""
    given = []
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, f, *_: given.append((self, f)) or self)
        make()
    rows, f = given[-1]
    batch = rows.toArrow().combine_chunks().to_batches()[0]
    return batch, list(f(iter([batch])))


def test_segments_of_many_texts_leave_a_task_together(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a😀bcd").alias("text"))
    marks = docs.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("start_at"), F.lit(3).alias("end_at"), F.lit("T").alias("entity_type"))
    batch, out = _given_to_python(monkeypatch, docs, lambda: redact.redact_segments(docs, marks))
    assert len(out) == 1 and batch.num_rows == 300
    got = sorted(zip(*(c.to_pylist() for c in out[0].columns), strict=True), key=lambda r: r[:2])
    assert len(got) == 600 and got[:4] == [(0, 0, 1, None, "a"), (0, 1, 3, "T", "😀b"), (0, 3, 5, None, "cd"), (1, 0, 5, None, "a😀bcd")]


def test_places_of_many_texts_leave_a_task_together(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("é😀中"), F.col("id").cast("string")).alias("text"))
    marks = docs.select("doc_id", F.lit(1).alias("start_at"), F.lit(3).alias("end_at")).unionByName(docs.select("doc_id", F.lit(2).alias("start_at"), F.lit(99).alias("end_at")))
    _, out = _given_to_python(monkeypatch, docs, lambda: spans.located(marks, docs))
    assert len(out) == 1
    got = {r.pop("doc_id") * 10 + r["start_at"]: r for r in out[0].to_pylist()}
    assert len(got) == 600
    for i in range(300):
        n = len(str(i))
        assert list(got[i * 10 + 1].values()) == [1, 3, "😀中", 2, 9, 1, 4] and list(got[i * 10 + 2].values()) == [2, 99, f"中{i}", 6, 9 + n, 3, 4 + n]


def test_spans_of_many_texts_leave_a_task_together(spark, monkeypatch):
    """As rows, in as many batches as the texts have runs; before that only lengths go in."""
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("😀\uFDD0 13812345678，"), F.col("id").cast("string"), F.lit("@b.cc"))).when(F.col("id") % 3 == 1, F.lit("none"))
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), text.alias("text"))
    batch, out = _given_to_python(monkeypatch, docs, lambda: detect.detect_all(docs))
    assert {str(c.type) for c in batch.columns[2:]} == {"list<element: int32>"} and len(out) == 3
    assert [t for t, i in zip(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist(), strict=True) if i % 3] == [None] * 1666
    got = sorted(tuple(r.values())[:5] for b in out for r in b.to_pylist())
    want = [s for i in range(0, 2500, 3) for s in ((i, "EMAIL", f"{i}@b.cc", 15, 20 + len(str(i))), (i, "PHONE", "13812345678", 3, 14))]
    assert got == want


def test_ids_of_spans_are_made_after_the_shuffle(spark):
    rows = [(i % 40, t, "x" * n, i % 7, i % 7 + n, s, "r", 1) for i in range(600) for t, n, s in (("A", 1 + i % 5, 0.5), ("B", 2, 0.4 + i % 3 / 10))]
    found = spark.createDataFrame(rows, "doc_id long, entity_type string, value string, start_at int, end_at int, score double, source string, detector_order int")
    kept = spans.resolve_conflicts(found)
    plan = plan_of(kept)
    assert plan.count("Exchange") == 1 and "sha2" in plan.split("Exchange")[0] and "sha2" not in plan.split("Exchange")[1]
    assert sorted(kept.collect()) == sorted(spans.resolve_conflicts(spans.with_entity_id(found)).collect()) and kept.count() > 40


def test_spans_and_texts_meet_without_a_broadcast(spark):
    text = F.when(F.col("id") % 5 > 0, F.concat(F.lit("a😀bcd"), F.col("id").cast("string")))
    docs = spark.range(2500).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text"))
    marks = docs.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("start_at"), F.lit(3).alias("end_at"), F.when(F.col("doc_id") % 3 > 0, F.lit("[T]")).alias("replacement"))
    marks = marks.unionByName(docs.where("doc_id % 4 = 0").select("doc_id", F.lit(4).alias("start_at"), F.lit(5).alias("end_at"), F.lit("[U]").alias("replacement")))
    out = redact.redact_documents(docs, marks)
    assert "Broadcast" not in plan_of(out)
    got = {r.doc_id: (r.redacted, r.n_spans, r.error) for r in out.collect()}
    assert len(got) == 2500
    for i, (redacted, n, error) in got.items():
        first = "a😀b" if i % 2 else "a" + ("[T]" if i % 3 else "")
        want = None if i % 5 == 0 else first + ("cd" if i % 2 else "c[U]" if i % 4 == 0 else "cd") + str(i)
        assert (redacted, n, error) == (want, 0 if i % 2 else 1 + (i % 4 == 0), None), i


def test_a_text_goes_to_python_once(spark):
    """Bounded parts of a batch; the same replacements as the table's."""
    docs = spark.createDataFrame([(1, "电话13812345678，邮箱a@b.cc"), (2, "x"), (3, "")], "doc_id long, text string")
    policies = spark.createDataFrame([("EMAIL", "")], "entity_type string, replacement string")
    out = redact.redact_texts(docs, None, policies)
    assert plan_of(out).count("ArrowEvalPython") == 1
    assert {r.doc_id: (r.redacted, r.n_spans, r.error) for r in out.collect()} == {1: ("电话138****5678，邮箱", 2, None), 2: ("x", 0, None), 3: (None, 0, "EMPTY_TEXT")}
    texts = pa.array(["x" * 700_000, None, "y" * 700_000, "z" * 3_000_000, *["w"] * 3000])
    parts = list(onepass.runs(texts))
    assert parts[:3] == [(0, 2), (2, 1), (3, 1)] and [n for _, n in parts[3:]] == [1024, 1024, 952] and list(onepass.runs(texts[:0])) == []


def test_a_replacement_in_a_task_is_that_of_the_table(spark):
    cases = [(t, v) for t in [*replacement.LABELS, "OTHER", None] for v in ("13812345678", "138", "北京大学", "某社", "")]
    rows = spark.createDataFrame(cases, "t string, v string").select("t", "v", replacement.default_replacement(F.col("t"), F.col("v")).alias("r")).collect()
    assert all(r.r == replacement.default_of(r.t, r.v) for r in rows) and len(rows) == len(cases)


@pytest.mark.parametrize("name", ["upsert_regions", "upsert_regions_reviews", "remove_regions", "reading_order", "external_annotations"])
def test_shuffles_have_parts_by_the_rows_of_the_table(spark, monkeypatch, name):
    """However few parts the session has, a task holds a bounded number of rows."""
    monkeypatch.setattr(inputs, "ROWS_A_PART", 100, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = {int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan_of(registry.QUERIES[name](spark, SF_DIR)))}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert parts == {-(-spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count() // 100)}
