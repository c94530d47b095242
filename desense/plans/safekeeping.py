"""Queries of encodings, sinks, vault, streams and user detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from desense.operators import detect, redact, tasks, vault
from desense.plans.masking import IDENTIFIED, NAMED, REPLACED, SPAN_OUT, detected_sql, full_sql, named, redacted_sql, resolved_contacts, resolved_sql
from desense.sources import encodings, sinks
from desense.sources.inputs import load, oracle, workspace
from desense.sources.store import Store
from desense.streaming import jobs

QUERIES: dict = {}
ORACLE: dict = {}
KEY = b"0123456789abcdef0123456789abcdef"


def query(name: str, sql: str | None = None, *inputs: str):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = oracle(sql, *inputs)
        return f

    return register


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact texts in the five encodings by id, some with a NUL, some invalid."""
    c, k = load(spark, sf_dir, "contacts"), F.col("doc_id") % 5
    code = F.when(k == 0, "utf-16le").when(k == 1, "utf-16be").when(k == 2, "utf-8-bom").when(k == 3, "utf-8").otherwise("gbk")
    base = F.when(k == 4, F.replace("text", F.lit("😀"), F.lit(""))).otherwise(F.col("text"))  # GBK has no emoji
    plain = F.when(F.col("doc_id") % 31 == 0, F.concat(base, F.lit("\0"))).otherwise(base)
    good, _ = encodings.encode_corpus(c.select("doc_id", plain.alias("text"), code.alias("encoding")))
    broken = F.when(F.col("doc_id") % 37 == 0, F.lit(bytes([0x80, 0xFF]))).otherwise(F.col("content"))
    path = workspace(spark)
    good.select("doc_id", broken.alias("content")).write.parquet(path)
    return spark.read.parquet(path)


@query("decode_corpus", """SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN replace(text, '😀', '') ELSE text END AS text,
  CASE doc_id % 5 WHEN 0 THEN 'utf-16le' WHEN 1 THEN 'utf-16be' WHEN 2 THEN 'utf-8-bom' WHEN 3 THEN 'utf-8' ELSE 'gbk' END AS encoding FROM contacts WHERE doc_id % 31 <> 0 AND doc_id % 37 <> 0""", "contacts")
def decode_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.decode_corpus(_raw(spark, sf_dir))[0]


@query("decode_quarantine", "SELECT doc_id, CASE WHEN doc_id % 37 = 0 THEN 'UNDECODABLE' ELSE 'NUL' END AS error FROM contacts WHERE doc_id % 31 = 0 OR doc_id % 37 = 0", "contacts")
def decode_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.decode_corpus(_raw(spark, sf_dir))[1]


#: A unit of UTF-16 as hexadecimal digits.
_UNIT = {"le": "printf('%02X%02X', {0} % 256, {0} // 256)", "be": "printf('%04X', {0})"}


def _utf16(order: str) -> str:
    unit = _UNIT[order].format
    return f"CASE WHEN u < 65536 THEN {unit('u')} ELSE {unit('(55296 + (u - 65536) // 1024)')} || {unit('(56320 + (u - 65536) % 1024)')} END"


@query("encode_corpus", f"""WITH t AS (SELECT doc_id, doc_id % 5 AS k, CASE WHEN doc_id % 5 = 4 THEN replace(text, '😀', '') ELSE text END AS text FROM contacts WHERE doc_id % 31 <> 0 AND doc_id % 37 <> 0),
c AS (SELECT doc_id, k, unnest(range(1, length(text) + 1)) AS i, unicode(substring(text, i, 1)) AS u FROM t),
h AS (SELECT doc_id, string_agg({_utf16('le')}, '' ORDER BY i) AS le, string_agg({_utf16('be')}, '' ORDER BY i) AS be, sum(CASE WHEN u < 128 THEN 1 ELSE 2 END) AS gbk FROM c GROUP BY 1)
SELECT t.doc_id, true AS same, CASE k WHEN 0 THEN 'FFFE' || le WHEN 1 THEN 'FEFF' || be WHEN 2 THEN 'EFBBBF' || hex(encode(text)) WHEN 3 THEN hex(encode(text)) END AS bytes,
  CASE k WHEN 4 THEN gbk WHEN 3 THEN strlen(text) WHEN 2 THEN strlen(text) + 3 ELSE strlen(le) // 2 + 2 END::INTEGER AS n FROM t JOIN h ON h.doc_id = t.doc_id""", "contacts")
def encode_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded texts, written again in their own encoding, give the same bytes, which are
    those of the encoding; GBK's are counted."""
    raw = _raw(spark, sf_dir)
    again, _ = encodings.encode_corpus(encodings.decode_corpus(raw)[0])
    rows = again.withColumnRenamed("content", "b").join(raw, "doc_id")
    return rows.select("doc_id", (F.col("b") == F.col("content")).alias("same"), F.when(F.col("doc_id") % 5 != 4, F.hex("b")).alias("bytes"), F.octet_length("b").alias("n"))


@query("write_redacted", full_sql("contacts") + " SELECT doc_id, redacted FROM red", "contacts", "rules", "policies")
def write_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = resolved_contacts(spark, sf_dir)
    path = workspace(spark)
    sinks.write_redacted(redact.redact_documents(docs, found), path)
    return spark.read.parquet(path)


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "contacts").select(F.col("doc_id").alias("id"), F.lit("original").alias("part"), F.col("text").cast("binary").alias("content"))


@query("vault_seal", "SELECT doc_id AS id, 'original' AS part, strlen(text) + 28 AS n, text AS opened, true AS fresh, true AS bound FROM contacts", "contacts")
def vault_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed bytes have 12 of nonce and 16 of tag; AES-GCM opens them with the row's own id
    and part and no other; sealed again they are others."""
    values = _values(spark, sf_dir)
    path = workspace(spark)
    vault.vault_seal(values, KEY).write.parquet(path)
    sealed, again = spark.read.parquet(path), vault.vault_seal(values, KEY).withColumnRenamed("sealed", "again")
    opens = lambda aad: F.call_function("try_aes_decrypt", "sealed", F.lit(KEY), F.lit("GCM"), F.lit("DEFAULT"), aad)
    own, other = vault._aad(F.col("id"), F.col("part")), vault._aad(F.col("id") + 1, F.col("part"))
    rows = sealed.join(again, ["id", "part"])
    return rows.select("id", "part", F.octet_length("sealed").cast("long").alias("n"), opens(own).cast("string").alias("opened"), (F.col("sealed") != F.col("again")).alias("fresh"), opens(other).isNull().alias("bound"))


@query("vault_open", "SELECT doc_id AS id, text FROM contacts WHERE doc_id % 13 <> 0", "contacts")
def vault_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows moved to another id don't open."""
    sealed = vault.vault_seal(_values(spark, sf_dir), KEY)
    moved = sealed.withColumn("id", F.when(F.col("id") % 13 == 0, F.col("id") + 1).otherwise(F.col("id")))
    return vault.vault_open(moved, KEY)[0].select("id", F.col("content").cast("string").alias("text"))


@query("vault_chunks", "SELECT doc_id AS id, ((strlen(text) + 15) // 16)::BIGINT AS chunks FROM contacts", "contacts")
def vault_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.vault_chunks(_values(spark, sf_dir), KEY, 16).groupBy("id").agg(F.count(F.lit(1)).alias("chunks"))


@query("vault_restore", "SELECT doc_id AS id, CASE WHEN doc_id % 13 <> 0 THEN text END AS text, CASE WHEN doc_id % 13 = 0 THEN 'AUTHENTICATION_FAILED' END AS error FROM contacts", "contacts")
def vault_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that lost their second chunk are refused."""
    chunks = vault.vault_chunks(_values(spark, sf_dir), KEY, 16).where("not (id % 13 = 0 and n = 1)")
    good, bad = vault.vault_restore(chunks, KEY)
    return good.select("id", F.col("content").cast("string").alias("text"), F.lit(None).cast("string").alias("error")).unionByName(bad.select("id", F.lit(None).cast("string").alias("text"), "error"))


@query("vault_selfcheck", "SELECT count(*) AS total, count(*) AS matched FROM contacts", "contacts")
def vault_selfcheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _values(spark, sf_dir)
    return vault.vault_selfcheck(values, vault.vault_seal(values, KEY), KEY)


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is now; the rows of its sink."""
    spark = stream.sparkSession
    out = workspace(spark)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    else:
        write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")
        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    return rows if mode == "append" else rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


def _stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A derived input as a file stream."""
    path = workspace(spark)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("stream_redact", full_sql("contacts") + " SELECT doc_id, redacted, n_spans, NULL::VARCHAR AS error FROM red", "contacts", "rules", "policies")
def stream_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch's rules on a stream."""
    docs = _stream(spark, load(spark, sf_dir, "contacts"))
    return _drained(jobs.stream_redact(docs, load(spark, sf_dir, "rules"), load(spark, sf_dir, "policies")), "append")


def _in_steps(spark: SparkSession, path: str, rows: DataFrame, ts: str, first: int, last: int, steps: int = 4, files: int = 2) -> DataFrame:
    """Rows of the given steps of time, written one after another below ``path``, each to so
    many files, as a file stream that reads them in that order."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = [float("-inf"), *rows.select(at.alias("us")).approxQuantile("us", [i / steps for i in range(1, steps)], 0.001), float("inf")]
    for lo, hi in list(zip(cuts, cuts[1:], strict=False))[first:last]:
        rows.where((at > lo) & (at <= hi)).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


#: Rows of a file of a step, about.
_ROWS_A_FILE = 1 << 21


def _files(kept: DataFrame, steps: int = 4) -> int:
    """How many files the rows of a stored table need in each step."""
    return max(2, -(-kept.count() // steps // _ROWS_A_FILE))


def _kept(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows that several steps read, written once."""
    path = workspace(spark)
    rows.write.parquet(path)
    return spark.read.parquet(path)


def _into(stream: DataFrame, sink, path: str) -> None:
    """Run a stream into a sink of micro-batches, from its checkpoint on, with its state on
    disk."""
    with jobs.state_on_disk(stream.sparkSession):
        stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()


@query("stream_live_jobs", f"""WITH snap AS (SELECT job_id, arg_max(state, seq) AS state, max(seq)::BIGINT AS seq, min(CASE WHEN state IN {tuple(tasks.TERMINAL)} THEN ts END) AS finished_at FROM state_log GROUP BY 1)
SELECT job_id, state, seq FROM snap WHERE finished_at IS NULL UNION ALL (SELECT job_id, state, seq FROM snap WHERE finished_at IS NOT NULL ORDER BY finished_at DESC, job_id DESC LIMIT 20)""", "state_log")
def stream_live_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs kept by the stream over several micro-batches and a restart half way; nothing is
    late, and finished jobs are held, so they equal the log's."""
    path = workspace(spark)
    store, log = Store(spark, f"{path}-jobs"), _kept(spark, load(spark, sf_dir, "state_log"))
    for first, last in ((0, 2), (2, 4)):
        updates = _in_steps(spark, path, log, "ts", first, last, files=_files(log))
        _into(jobs.live_jobs(updates, "36500 days"), jobs.upsert_jobs(store, 20), path)
    return store.read("jobs").select("job_id", "state", "seq")


@query("stream_live_progress", """SELECT batch_id, count_if(state = 'completed')::BIGINT AS done, count(*) AS total, sum(CASE state WHEN 'completed' THEN 100 WHEN 'awaiting_review' THEN 55 ELSE 0 END)::BIGINT AS percent_sum FROM batch_items GROUP BY 1""", "batch_items")
def stream_live_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of batches whose items come in several micro-batches, with a restart; every
    item was analyzing before."""
    path = workspace(spark)
    store, items = Store(spark, f"{path}-progress"), load(spark, sf_dir, "batch_items")
    rows = items.withColumn("items", F.count(F.lit(1)).over(Window.partitionBy("batch_id"))).select("batch_id", "idx", "items", F.explode(F.array(F.struct(F.lit("analyzing").alias("state"), F.lit(0).alias("at")), F.struct(F.col("state"), F.lit(50).alias("at")))).alias("s"))
    rows = rows.select("batch_id", "idx", "items", "s.state", F.timestamp_seconds(F.col("s.at") + F.col("idx")).alias("ts"))
    rows = _kept(spark, rows)
    for first, last in ((0, 1), (1, 4)):
        updates = _in_steps(spark, path, rows, "ts", first, last, files=_files(rows))
        _into(jobs.live_progress(updates, "36500 days"), jobs.upsert_progress(store), path)
    return store.read("progress")


_WAITED = "doc_id % 7 IN (3, 5) OR doc_id % 11 = 6"


@query("stream_redact_annotated", f"""WITH RECURSIVE {detected_sql('contacts', out='found')}, det AS (SELECT {SPAN_OUT} FROM found UNION ALL {NAMED}), ident AS ({IDENTIFIED}), {resolved_sql('ident')}, {REPLACED}, {redacted_sql('contacts', 'rep')}
SELECT doc_id, CASE WHEN {_WAITED} THEN NULL ELSE redacted END AS redacted, CASE WHEN {_WAITED} THEN 0 ELSE n_spans END::INTEGER AS n_spans, CASE WHEN {_WAITED} THEN 'MODELS_NOT_READY' END AS error FROM red""", "contacts", "rules", "policies")
def stream_redact_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and annotations as two streams: some annotations failed, some are missing,
    some come half an hour late, and some twice."""
    docs = load(spark, sf_dir, "contacts").withColumn("arrived_at", F.timestamp_seconds(F.col("doc_id") * 10 + 10**9))
    late = F.when(F.col("doc_id") % 11 == 6, 1800).otherwise(F.col("doc_id") % 60)
    spans = named(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("entity_type", "start_at", "end_at", "score", "source")).cast(detect.ANNOTATION).alias("spans"))
    notes = docs.where("doc_id % 7 <> 5").join(spans, "doc_id", "left").select("doc_id", (F.col("doc_id") % 7 != 3).alias("ok"), "spans", F.timestamp_seconds(F.col("doc_id") * 10 + late + 10**9).alias("annotated_at"))
    notes = notes.withColumn("n", F.explode(F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("n")
    # a last row of each stream, after all others, so that all are waited for to the end
    end = docs.agg((F.max("doc_id") * 10 + 10**9 + 10**6).alias("end")).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("end").alias("text"), F.timestamp_seconds("end").alias("at"))
    docs = docs.unionByName(end.withColumnRenamed("at", "arrived_at"))
    notes = notes.unionByName(end.select("doc_id", F.lit(True).alias("ok"), F.lit(None).cast(detect.ANNOTATION).alias("spans"), F.col("at").alias("annotated_at")))
    path = workspace(spark)
    a, b = _in_steps(spark, f"{path}-d", docs, "arrived_at", 0, 4), _in_steps(spark, f"{path}-n", notes, "annotated_at", 0, 4)
    return _drained(jobs.stream_redact_annotated(a, b, load(spark, sf_dir, "rules"), load(spark, sf_dir, "policies")), "append").where("doc_id >= 0")


@query("stream_job_status", "SELECT job_id, arg_max(state, seq) AS state, max(seq) AS seq FROM state_log GROUP BY 1", "state_log")
def stream_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(jobs.stream_job_status(_stream(spark, load(spark, sf_dir, "state_log"))), "complete")


@query("stream_progress", """SELECT batch_id, count_if(state = 'completed')::BIGINT AS done, count(*) AS total, sum(CASE state WHEN 'completed' THEN 100 WHEN 'awaiting_review' THEN 55 ELSE 0 END)::BIGINT AS percent_sum FROM batch_items GROUP BY 1""", "batch_items")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(jobs.stream_progress(_stream(spark, load(spark, sf_dir, "batch_items"))), "complete")


@query("stream_entity_counts", f"WITH {detected_sql('contacts')} SELECT entity_type, count(*) AS n FROM det GROUP BY 1", "contacts", "rules")
def stream_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(jobs.stream_entity_counts(_stream(spark, load(spark, sf_dir, "contacts")), load(spark, sf_dir, "rules")), "complete")


def _name_detector(frames):
    """A user's detector: the eighteen characters of a customer's name. It can't stand a
    smile."""
    import pandas as pd

    for f in frames:
        texts = f["text"].tolist()
        if any("😀" in t for t in texts):
            raise RuntimeError("no smiles")
        hits = [(d, at) for d, at in ((d, t.find("Customer#")) for d, t in zip(f["doc_id"].tolist(), texts, strict=True)) if at >= 0]
        yield pd.DataFrame([(d, "PERSON", at, at + 18, 0.8) for d, at in hits], columns=["doc_id", "entity_type", "start_at", "end_at", "score"])


_MODEL = "SELECT doc_id, 'PERSON' AS entity_type, substring(text, strpos(text, 'Customer#'), 18) AS value, (strpos(text, 'Customer#') - 1)::INTEGER AS start_at, (strpos(text, 'Customer#') + 17)::INTEGER AS end_at, 0.8::DOUBLE AS score, 'model' AS source, 0::INTEGER AS detector_order FROM contacts WHERE contains(text, 'Customer#') AND NOT contains(text, '😀')"


@query("register_detector", _MODEL, "contacts")
def register_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.register_detector(load(spark, sf_dir, "contacts"), _name_detector)[0]


@query("detector_failures", "SELECT doc_id, 'MODELS_NOT_READY' AS error, 'RuntimeError: no smiles' AS failure FROM contacts WHERE contains(text, '😀')", "contacts")
def detector_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.register_detector(load(spark, sf_dir, "contacts"), _name_detector)[1]


@query("redact_with_detector", f"""WITH RECURSIVE {detected_sql('contacts', out='found')}, det AS (SELECT {SPAN_OUT} FROM found UNION ALL {_MODEL}), ident AS ({IDENTIFIED}), {resolved_sql('ident')}, {REPLACED}, {redacted_sql('contacts', 'rep')}
SELECT red.doc_id, CASE WHEN contains(text, '😀') THEN NULL ELSE redacted END AS redacted, CASE WHEN contains(text, '😀') THEN 0 ELSE n_spans END::INTEGER AS n_spans, CASE WHEN contains(text, '😀') THEN 'MODELS_NOT_READY' END AS error FROM red JOIN contacts c ON c.doc_id = red.doc_id""", "contacts", "rules", "policies")
def redact_with_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's detector in the redaction's pass; where it raises, that document fails."""
    return redact.redact_texts(load(spark, sf_dir, "contacts"), load(spark, sf_dir, "rules"), load(spark, sf_dir, "policies"), detector=_name_detector)


@query("validate_rules", """SELECT p_partkey AS rule_id, CASE p_partkey % 6 WHEN 1 THEN 'BLANK' WHEN 2 THEN 'REFUSED_CONSTRUCT' WHEN 3 THEN 'MATCHES_EMPTY' WHEN 4 THEN 'DOES_NOT_COMPILE' WHEN 5 THEN 'TERMS' END AS error FROM part""")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    pattern = F.when(k == 2, "(?<=a)b").when(k == 3, "a*").when(k == 4, "(").when(k == 5, " \n ").otherwise(F.col("p_brand"))
    rules = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("rule_id"), F.when(k == 1, " ").otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("entity_type"),
        F.when(k == 5, "dictionary").when(k == 0, "literal").otherwise("regex").alias("kind"), pattern.alias("pattern"),
    )
    return detect.validate_rules(rules)
