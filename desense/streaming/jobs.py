"""Streams: continuous redaction, job states, progress, counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from desense.operators import detect, onepass, redact, tasks
from desense.operators.tasks import TERMINAL
from desense.sources.store import Store

#: Percent done at each stage of a job.
STAGE_PERCENT = {"analyzing": 10, "awaiting_review": 55, "processing": 90, "completed": 100}

#: Parts of a stream's keyed state. A part is one state row and one call in a micro-batch, as
#: a call costs a millisecond, however few rows it has.
STATE_PARTS = 2048
#: Updates of a part that are merged into its items at a time, at least.
ROWS_AT_ONCE = 1 << 17
#: Settings of a stream whose state is in files of the executors' own disks. Spark's default
#: holds several versions of all state in the executors' heaps. The memory is an executor's,
#: for all its parts together.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: States in which a job has finished.
FINISHED = tuple(TERMINAL)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start within it keep their state on disk (``STATE_ON_DISK``)."""
    was = {k: spark.conf.get(k, None) for k in STATE_ON_DISK}
    try:
        for k, v in STATE_ON_DISK.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stream_redact(docs: DataFrame, rules: DataFrame | None = None, policies: DataFrame | None = None) -> DataFrame:
    """(doc_id, redacted, n_spans, error) of a stream of documents: what ``redact_texts``
    makes of the same rows, with all its rules; stateless. ``rules`` and ``policies`` are
    tables, read when the stream starts."""
    return redact.redact_texts(docs, rules, policies if policies is not None else _no_policies(docs))


def _no_policies(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], "entity_type string, replacement string")


def stream_redact_annotated(docs: DataFrame, annotations: DataFrame, rules: DataFrame | None = None, policies: DataFrame | None = None, wait: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """(doc_id, redacted, n_spans, error) of documents (doc_id, text, arrived_at) that wait
    for their annotation (doc_id, ok, spans, annotated_at), another stream.

    An annotation counts if it is of the time from ``wait`` before its document to ``wait``
    after it; the first of a document counts. A document whose annotation failed, has spans
    outside the text or is not there when the watermark has passed the time fails, without
    a redacted text. ``late`` bounds how much out of order rows of a stream come, and
    with ``wait`` what the state holds; documents that come later than that are dropped, as
    rows of a stream are, and have no output.
    """
    patterns, few, table = detect.compiled_rules(rules)
    if table is not None:
        raise ValueError("too many rules for a stream")
    d = docs.select("doc_id", "text", "arrived_at").withWatermark("arrived_at", late)
    a = annotations.select(F.col("doc_id").alias("_id"), "ok", "spans", "annotated_at").withWatermark("annotated_at", late).dropDuplicatesWithinWatermark(["_id"])
    near = F.expr(f"_id = doc_id AND annotated_at BETWEEN arrived_at - INTERVAL {wait} AND arrived_at + INTERVAL {wait}")
    rows = d.join(a, near, "left").select("doc_id", "text", "ok", "spans")
    known = redact.policy_map(policies) if policies is not None else {}
    return onepass.redacted(rows, detect.BUILT_INS + patterns, few, known, annotated=True)


def stream_job_status(updates: DataFrame) -> DataFrame:
    """State of each job: its latest update wins. For update or complete mode, over jobs
    whose number is bounded; ``live_jobs`` forgets finished ones."""
    return updates.groupBy("job_id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def live_jobs(updates: DataFrame, hold: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(job_id, state, seq, finished_at) of jobs that updates (job_id, state, seq, ts) change,
    in update mode. A job's latest update wins; finished_at is when it first finished.

    A finished job leaves the state once the watermark is ``hold`` past its last update, so
    the state holds running jobs and those that finished of late. Updates without a time are
    left out. Jobs of a part (``STATE_PARTS``) are one state row.
    """
    keep = int(pd.Timedelta(hold).total_seconds() * 1000)

    def latest(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {j: [s, q, f, t] for j, s, q, f, t in zip(*state.get, strict=True)} if state.exists else {}
        changed: dict = {}
        for frame in frames:
            for job, s, q, us in zip(*(frame[c].tolist() for c in ("job_id", "state", "seq", "us")), strict=True):
                job, s = _text(job), _text(s)
                own = known.setdefault(job, [None, -1, None, 0])
                if s in FINISHED:
                    own[2] = us if own[2] is None else min(own[2], us)
                if q > own[1]:
                    own[0], own[1] = s, int(q)
                own[3] = max(own[3], us)
                changed[job] = own
        due = {j: own[3] // 1000 + keep for j, own in known.items() if own[2] is not None}
        _forget(state, known, due, changed, lambda: ([*known], *map(list, zip(*known.values(), strict=True))))
        if changed:
            was, seq, finished, _ = zip(*changed.values(), strict=True)
            yield pd.DataFrame({"job_id": [*changed], "state": was, "seq": seq, "finished": pd.array(finished, "Int64")})

    kind = updates.schema["job_id"].dataType
    rows = _timed(updates, late, _part("job_id"), F.col("job_id").cast("string").alias("job_id"), "state", F.col("seq").cast("long").alias("seq"))
    found = rows.groupBy("_part").applyInPandasWithState(
        latest, "job_id string, state string, seq long, finished long", "job array<string>, state array<string>, seq array<long>, finished array<long>, last array<long>", "update", GroupStateTimeout.EventTimeTimeout,
    )
    return found.select(F.col("job_id").cast(kind).alias("job_id"), "state", "seq", F.timestamp_micros("finished").alias("finished_at"))


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(STATE_PARTS)).cast("int").alias("_part")


def _text(value) -> str | None:
    """A string of a pandas column, which may have other things for null."""
    return value if isinstance(value, str) else None


def _forget(state: GroupState, known: dict, due: dict, changed: dict, packed: Callable[[], tuple]) -> None:
    """Leave out of ``known`` what is due and not changed just now, store the rest, and set
    the timer to what is due next."""
    now = state.getCurrentWatermarkMs()
    for key in [k for k, t in due.items() if t <= now and k not in changed]:
        del known[key], due[key]
    if not known:
        state.remove()
        return
    state.update(packed())
    if due:
        state.setTimeoutTimestamp(max(min(due.values()), now + 1))


def _timed(rows: DataFrame, late: str, *columns) -> DataFrame:
    """Rows with a time, with a watermark, and the time in microseconds as ``us``."""
    ts = F.col("ts").cast("timestamp")
    return rows.where("ts is not null").select(*columns, ts.alias("ts"), F.unix_micros(ts).alias("us")).withWatermark("ts", late)


def live_progress(items: DataFrame, hold: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(batch_id, done, total, percent_sum) of batches that updates of their items (batch_id,
    idx, state, items, ts) change, in update mode; ``items`` is how many a batch has. The
    last update of an item counts, by time. A batch whose items are all done leaves the state
    once the watermark is ``hold`` past its last update. Batches of a part (``STATE_PARTS``)
    are one state row, with their items as compressed columns. The state has every item of
    the batches that run or are held: start it in ``state_on_disk``."""
    keep = int(pd.Timedelta(hold).total_seconds() * 1000)

    def counted(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (keys, total), (batch, idx, us, code), names = (*map(_unpacked, state.get[:2]), state.get[2]) if state.exists else _NO_ITEMS
        changed = np.zeros(len(keys), bool)
        for rows in _gathered(frames, max(ROWS_AT_ONCE, len(idx))):
            keys, of = _with_keys(keys, rows["batch_id"])
            total, changed = (np.append(x, np.zeros(len(keys) - len(x), x.dtype)) for x in (total, changed))
            np.maximum.at(total, of, rows["items"].fillna(0).to_numpy(np.int64))
            changed[of] = True
            names, code, new = _with_names(names, code, rows["state"])
            batch, idx, us, code = _last_updates(*(np.append(x, y) for x, y in ((batch, of), (idx, rows["idx"].fillna(_NO_IDX).to_numpy(np.int64)), (us, rows["us"].to_numpy(np.int64)), (code, new))))
        first = np.flatnonzero(np.append(True, batch[1:] != batch[:-1]))  # a batch's first item: all have one
        done, percent = (np.add.reduceat(np.array(x, np.int64)[code], first) for x in ([n == "completed" for n in names], [STAGE_PERCENT.get(n, 0) for n in names]))
        ended, due, now = done >= total, np.maximum.reduceat(us, first) // 1000 + keep, state.getCurrentWatermarkMs()
        stay = ~ended | (due > now) | changed
        if not stay.any():
            state.remove()
        else:
            held = stay[batch]
            place = np.cumsum(stay) - 1
            state.update((_packed(key=pa.array(keys[stay], pa.string()), total=total[stay]), _packed(batch=place[batch[held]], idx=idx[held], us=us[held], code=code[held]), [*names]))
            if (stay & ended).any():
                state.setTimeoutTimestamp(max(int(due[stay & ended].min()), now + 1))
        if changed.any():
            yield pd.DataFrame({"batch_id": keys[changed], "done": done[changed], "total": total[changed], "percent_sum": percent[changed]})

    kind = items.schema["batch_id"].dataType
    rows = _timed(items, late, _part("batch_id"), F.col("batch_id").cast("string").alias("batch_id"), F.col("idx").cast("int").alias("idx"), "state", F.col("items").cast("long").alias("items"))
    found = rows.groupBy("_part").applyInPandasWithState(
        counted, "batch_id string, done long, total long, percent_sum long", "batches binary, items binary, states array<string>", "update", GroupStateTimeout.EventTimeTimeout,
    )
    return found.select(F.col("batch_id").cast(kind).alias("batch_id"), "done", "total", "percent_sum")


#: Stands for an item's missing number, as no int is so large.
_NO_IDX = 1 << 40
#: A part's batches (key, total), its items (place of the batch, number, time, place of the
#: state), by batch and number, and the names of states, in order.
_NO_ITEMS = (np.empty(0, object), np.empty(0, np.int64)), (np.empty(0, np.int64),) * 4, []


def _packed(**columns) -> bytes:
    rows, out = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(rows)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> list[np.ndarray]:
    with pa.ipc.open_stream(data) as stream:
        return [c.to_numpy() for c in stream.read_all().columns]


def _gathered(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The rows of frames, about ``most`` at a time."""
    rows: list = []
    for frame in frames:
        rows += [frame] if len(frame) else []
        if sum(map(len, rows)) >= most:
            yield pd.concat(rows, ignore_index=True)
            rows = []
    if rows:
        yield pd.concat(rows, ignore_index=True)


def _with_keys(keys: np.ndarray, new: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Keys and then those that are new, each once, and the places of ``new`` in them."""
    places, every = pd.factorize(np.append(keys, new.to_numpy(object)), use_na_sentinel=False)
    return np.where(pd.isna(every), None, every), places[len(keys):]


def _with_names(names: list[str], code: np.ndarray, new: pd.Series) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names with those that are new, in order, and the places in them of what ``code`` and
    ``new`` name; a missing name is an empty one."""
    places, found = pd.factorize(new.fillna("").to_numpy(object))
    every = sorted({*names, *found})
    at = {n: i for i, n in enumerate(every)}
    return every, *(np.array([at[n] for n in some], np.int64)[of] for some, of in ((names, code), (found, places)))


def _last_updates(batch: np.ndarray, idx: np.ndarray, us: np.ndarray, code: np.ndarray) -> list[np.ndarray]:
    """The last update of each item, by batch and number."""
    order = np.lexsort((code, us, idx, batch))
    b, i = batch[order], idx[order]
    order = order[np.append((b[1:] != b[:-1]) | (i[1:] != i[:-1]), True)]
    return [x[order] for x in (batch, idx, us, code)]


def upsert_jobs(store: Store, most: int = 256) -> Callable[[DataFrame, int], None]:
    """A sink of ``live_jobs``: table ``jobs`` of the store has all running jobs and the
    ``most`` that finished last. Each micro-batch is one version, which notes it, so one
    that comes again after a restart changes nothing."""

    def write(rows: DataFrame, batch: int) -> None:
        if not _new(store, batch):
            return
        if store.version():
            rows = rows.unionByName(store.read("jobs"))
        jobs = rows.groupBy("job_id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"), F.min("finished_at").alias("finished_at"))
        store.commit(store.version(), str(batch), jobs=tasks.retained_jobs(jobs, most))

    return write


def upsert_progress(store: Store) -> Callable[[DataFrame, int], None]:
    """A sink of ``live_progress``: table ``progress`` of the store, a row a batch. A micro-batch's
    rows are used once, as the state would be gone through again for another use."""

    def write(rows: DataFrame, batch: int) -> None:
        if not _new(store, batch):
            return
        if store.version():
            both = rows.withColumn("_new", F.lit(True)).unionByName(store.read("progress").withColumn("_new", F.lit(False)))
            rows = both.groupBy("batch_id").agg(*(F.max_by(c, "_new").alias(c) for c in rows.columns if c != "batch_id"))
        store.commit(store.version(), str(batch), progress=rows)

    return write


def _new(store: Store, batch: int) -> bool:
    note = store.manifest()["note"]
    return note is None or batch > int(note)


def stream_progress(items: DataFrame) -> DataFrame:
    """Done and total of each batch, and the mean percent of its items' stages."""
    percent = F.coalesce(F.create_map(*[F.lit(x) for kv in STAGE_PERCENT.items() for x in kv])[F.col("state")], F.lit(0))
    return items.groupBy("batch_id").agg(F.count_if(F.col("state") == "completed").alias("done"), F.count(F.lit(1)).alias("total"), F.sum(percent.cast("long")).alias("percent_sum"))


def stream_entity_counts(docs: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Running counts of matches by type."""
    patterns, few, table = detect.compiled_rules(rules)
    if table is not None:
        raise ValueError("too many rules for a stream")
    return onepass.all_spans(docs, detect.BUILT_INS + patterns, few).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
