"""Streams that keep state: what they forget, restarts, sinks that are told twice."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from desense.operators import detect
from desense.plans import safekeeping
from desense.sources.store import Store
from desense.streaming import jobs

START = datetime.datetime(2024, 1, 1)
UPDATE = "job_id long, state string, seq long, ts timestamp"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


class Feed:
    """A file stream to which rows are added; each call runs it from its checkpoint on."""

    def __init__(self, spark, path, schema, make, sink):
        self.spark, self.path, self.schema, self.make, self.sink = spark, str(path), schema, make, sink

    def run(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        stream = self.make(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path))
        query = stream.writeStream.outputMode("update").foreachBatch(self.sink).option("checkpointLocation", f"{self.path}-state").trigger(availableNow=True).start()
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_finished_jobs_leave_the_state(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    feed = Feed(spark, tmp_path / "in", UPDATE, lambda s: jobs.live_jobs(s, "30 minutes", "1 minute"), jobs.upsert_jobs(store, 8))
    sizes = []
    for k in range(6):
        now = 60 * k
        rows = [(10 * k + i, "analyzing", 1, at(now)) for i in range(10)] + [(10 * k + i, "completed", 2, at(now + 1)) for i in range(9)]
        sizes += feed.run(rows + [(10_000, "processing", k, at(now + 2))])
    # of 61 jobs: the last ten or twenty, one of each earlier ten that still runs, and the last
    assert max(sizes) <= 2 * 10 + 6 + 1 and sizes[-1] < 30
    got = {r.job_id: (r.state, r.seq) for r in store.read("jobs").collect()}
    running = {10 * k + 9: ("analyzing", 1) for k in range(6)} | {10_000: ("processing", 5)}
    assert {j: s for j, s in got.items() if s[0] != "completed"} == running
    finished = {j for j, s in got.items() if s[0] == "completed"}
    assert len(finished) == 8 and finished <= set(range(50, 59))


def test_late_and_repeated_updates(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    feed = Feed(spark, tmp_path / "in", UPDATE, lambda s: jobs.live_jobs(s), jobs.upsert_jobs(store))
    feed.run([(1, "completed", 5, at(5)), (1, "analyzing", 3, at(3)), (2, "queued", 1, at(1)), (3, "queued", 1, None)])
    feed.run([(1, "processing", 4, at(4)), (2, "analyzing", 2, at(6)), (2, "analyzing", 2, at(6))])
    assert sorted((r.job_id, r.state, r.seq, r.finished_at) for r in store.read("jobs").collect()) == [(1, "completed", 5, at(5)), (2, "analyzing", 2, None)]


def test_a_micro_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    sink = jobs.upsert_jobs(store)
    rows = spark.createDataFrame([(1, "queued", 1, None)], "job_id long, state string, seq long, finished_at timestamp")
    sink(rows, 0)
    sink(rows.withColumn("seq", F.lit(2).cast("long")), 1)
    version = store.version()
    sink(rows.withColumn("seq", F.lit(9).cast("long")), 1)
    assert store.version() == version and store.read("jobs").first().seq == 2


def test_progress_ends_with_its_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    schema = "batch_id long, idx int, state string, items long, ts timestamp"
    feed = Feed(spark, tmp_path / "in", schema, lambda s: jobs.live_progress(s, "30 minutes", "1 minute"), jobs.upsert_progress(store))
    sizes = []
    for k in range(5):
        sizes += feed.run([(k, i, s, 3, at(60 * k + n)) for i in range(3) for n, s in enumerate(("analyzing", "completed"))] + [(99, 0, "awaiting_review", 2, at(60 * k + 3))])
    assert max(sizes) <= 6  # of 6 batches, two of which are held and one runs
    got = {r.batch_id: (r.done, r.total, r.percent_sum) for r in store.read("progress").collect()}
    assert got == {k: (3, 3, 300) for k in range(5)} | {99: (0, 2, 55)}


ITEM = "batch_id long, idx int, state string, items long, ts timestamp"


def test_progress_of_odd_updates(spark, tmp_path, monkeypatch):
    """Items that come again, late, twice at a time, or without a batch, number, state or
    count, a few at a time, equal a plain count."""
    monkeypatch.setattr(jobs, "ROWS_AT_ONCE", 16)
    r = random.Random(3)
    store = Store(spark, str(tmp_path / "s"))
    feed = Feed(spark, tmp_path / "in", ITEM, lambda s: jobs.live_progress(s, "36500 days", "1000 days"), jobs.upsert_progress(store))
    last, total = {}, {}
    for _ in range(3):
        rows = [(r.choice([*range(6), None]), r.choice([0, 1, 2, None]), r.choice(["completed", "analyzing", "other", None]), r.choice([3, 5, None]), r.choice([at(r.randrange(9)), None])) for _ in range(150)]
        feed.run(rows)
        for b, i, s, n, t in rows:
            if t is not None:
                last[b, i] = max(last.get((b, i), (t, "")), (t, s or ""))
                total[b] = max(total.get(b, 0), n or 0)
        states = {b: [s for (c, _), (_, s) in last.items() if c == b] for b in total}
        want = [(b, s.count("completed"), total[b], sum(jobs.STAGE_PERCENT.get(x, 0) for x in s)) for b, s in states.items()]
        assert sorted(map(tuple, store.read("progress").collect()), key=str) == sorted(want, key=str)


def test_state_of_live_streams_is_on_disk(spark, tmp_path):
    """Not in the executors' heaps: the checkpoint has files of a store on disk alone."""
    was = {k: spark.conf.get(k, None) for k in jobs.STATE_ON_DISK}
    make = {
        "progress": (ITEM, [(1, 0, "completed", 1, at(0))], jobs.live_progress, jobs.upsert_progress),
        "jobs": (UPDATE, [(1, "completed", 1, at(0))], jobs.live_jobs, jobs.upsert_jobs),
    }
    for name, (schema, rows, live, sink) in make.items():
        path, store = str(tmp_path / name), Store(spark, str(tmp_path / f"{name}-s"))
        spark.createDataFrame(rows, schema).write.parquet(path)
        safekeeping._into(live(spark.readStream.schema(schema).parquet(path)), sink(store), path)
        kinds = {f.suffix for f in (tmp_path / f"{name}-state" / "state" / "0" / "0").iterdir()}
        assert ".zip" in kinds and ".delta" not in kinds and store.read(name).count() == 1
    assert {k: spark.conf.get(k, None) for k in jobs.STATE_ON_DISK} == was


@pytest.mark.parametrize("sink, schema", [(jobs.upsert_progress, "batch_id long, done long, total long, percent_sum long"), (jobs.upsert_jobs, "job_id long, state string, seq long, finished_at timestamp")], ids=["progress", "jobs"])
def test_a_micro_batch_is_made_once(spark, tmp_path, sink, schema):
    """A sink that uses its rows twice has the state gone through twice."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        made.add(1)
        return x

    write, names = sink(Store(spark, str(tmp_path / "s"))), [f.split()[0] for f in schema.split(", ")]
    for n in range(2):
        rows = spark.range(10).select(seen("id").alias(names[0]), *(F.lit(None).alias(c) for c in names[1:]))
        rows = spark.createDataFrame([], schema).unionByName(rows)
        rows = spark._jsparkSession.internalCreateDataFrame(rows._jdf.queryExecution().toRdd(), rows._jdf.schema(), False)  # as a micro-batch is
        write(type(spark.range(0))(rows, spark), n)
    assert made.value == 20


@pytest.mark.parametrize("note, error", [
    ((True, [("PERSON", 0, 4, 0.9, "model")], 2), None), ((True, [("PERSON", 0, 4, 0.1, "model")], 2), "low"), ((False, [], 2), "MODELS_NOT_READY"), (None, "MODELS_NOT_READY"), ((True, [], 90), "MODELS_NOT_READY"), ((True, [("PERSON", 0, 99, 0.9, "model")], 2), "SPAN_OUTSIDE"),
], ids=["there", "unsure", "failed", "missing", "late", "outside"])
def test_annotations_of_a_stream(spark, tmp_path, note, error):
    docs = [(1, "anna x@y.zz", at(1)), (-1, "end", at(10_000))]
    notes = [(1, note[0], note[1], at(note[2]))] if note else []
    notes.append((-1, True, [], at(10_000)))
    spark.createDataFrame(docs, "doc_id long, text string, arrived_at timestamp").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(notes, f"doc_id long, ok boolean, spans {detect.ANNOTATION}, annotated_at timestamp").write.parquet(str(tmp_path / "n"))
    d, n = (spark.readStream.schema(spark.read.parquet(str(tmp_path / x)).schema).parquet(str(tmp_path / x)) for x in "dn")
    out = jobs.stream_redact_annotated(d, n)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r.redacted, r.error) for r in spark.read.parquet(str(tmp_path / "out")).where("doc_id = 1").collect()]
    assert got == [{None: ("某人 ***@***", None), "low": ("anna ***@***", None)}.get(error, (None, error))]
