"""Task, batch and job tables: states, names, counts, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Legal state changes, error catalogue, reserved names, accepted extensions.
TRANSITIONS = {
    "queued": ["analyzing", "cancelled", "failed"],
    "analyzing": ["awaiting_review", "failed", "cancelled"],
    "awaiting_review": ["processing", "cancelled", "failed"],
    "processing": ["completed", "partial", "failed", "cancelled"],
}
TERMINAL = ["completed", "partial", "failed", "cancelled"]
ERRORS = [
    ("INVALID_INPUT", "检查文件格式、大小或输入内容后重试", True),
    ("MODELS_NOT_READY", "前往模型管理完成安装和校验", True),
    ("INVALID_TASK_STATE", "刷新任务状态后重试", False),
    ("REVISION_CONFLICT", "刷新任务内容后重试", True),
    ("IO_ERROR", "检查磁盘空间和文件访问权限后重试", True),
    ("AUTHENTICATION_FAILED", "确认口令和恢复包后重试", True),
    ("UNSUPPORTED_FORMAT", "改用受支持的文件格式或处理模式", False),
    ("TASK_CANCELLED", "可以从原文件重新创建任务", True),
    ("INTERRUPTED", "请从原文件重新创建任务", True),
]
RESERVED = ["CON", "PRN", "AUX", "NUL"] + [f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)]
NO_NAME, NO_STEM, SUFFIX = "未命名文件", "未命名文件", "-脱敏结果"
EXTENSIONS = ["txt", "md", "docx", "xlsx", "pptx", "pdf", "png", "jpg", "jpeg", "bmp", "tif", "tiff"]
MOST_FILE_BYTES, MOST_TEXT_BYTES = 50 << 20, 8 << 20


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def safe_extension(path: Column) -> Column:
    """ASCII letters and digits, at most 16, lower case; else empty. A leading dot is no
    extension."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([A-Za-z0-9]{1,16})$", 1))


def stem(name: Column) -> Column:
    """A name without its extension."""
    return F.when(name.rlike(r"^.+\."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def safe_name(path: Column) -> Column:
    """A display name: control and path characters become ``_``, at most 180 characters,
    no dots or blanks at the end, reserved device names prefixed, a default if blank."""
    clean = F.left(F.regexp_replace(file_name(path), r'[\x00-\x1F\x7F-\x9F<>:"/\\|?*]', "_"), F.lit(180))
    name = F.regexp_replace(F.trim(clean), r"[. ]+$", "")
    return F.when(name == "", NO_NAME).when(F.upper(stem(name)).isin(RESERVED), F.concat(F.lit("_"), name)).otherwise(name)


def ingest_admission(files: DataFrame, most: int = MOST_FILE_BYTES) -> DataFrame:
    """files with ext and reject_code (null: accepted); only names and sizes are looked at.
    Where the files have text_bytes, the size of their text, it must be over 0 and at most
    8 MiB; it is null as long as the text is not known."""
    ext = safe_extension(F.col("path"))
    code = F.when(ext == "", "NO_EXTENSION").when(~ext.isin(EXTENSIONS), "UNSUPPORTED_FORMAT").when(F.coalesce("size_bytes", F.lit(0)) > most, "TOO_LARGE")
    if "text_bytes" in files.columns:
        code = code.when(F.col("text_bytes") == 0, "EMPTY_TEXT").when(F.col("text_bytes") > MOST_TEXT_BYTES, "TEXT_TOO_LARGE")
    return files.withColumn("ext", ext).withColumn("reject_code", code)


def batch_admission(files: DataFrame, most_files: int = 20, most_bytes: int = 500 << 20) -> DataFrame:
    n, size = F.count(F.lit(1)), F.sum(F.coalesce("size_bytes", F.lit(0)))
    verdict = F.when(F.col("n") > most_files, "TOO_MANY_FILES").when(F.col("total_bytes") > most_bytes, "TOO_LARGE").otherwise("ok")
    return files.groupBy("batch_id").agg(n.alias("n"), size.alias("total_bytes")).withColumn("verdict", verdict)


#: Parts that rows without a task are dealt to in a join by task.
LOOSE_PARTS = 4096


def _dealt(rows: DataFrame, tasks: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with ``tasks`` by task_id. Rows without a task meet none, and would all
    be of one join partition, so a second key deals them out; it follows from the task where
    there is one. (A constant there would be folded into a filter, and be no key.)"""
    own = F.xxhash64(*[c for c, t in rows.dtypes if c != "task_id" and not t.startswith("map")]) if len(rows.columns) > 1 else (F.rand(7) * (1 << 30)).cast("long")
    part = lambda h: F.pmod(h, F.lit(LOOSE_PARTS)).cast("int")
    rows = rows.withColumn("_loose", F.when(F.col("task_id").isNull(), part(own)).otherwise(part(F.xxhash64("task_id"))))
    return rows.join(tasks.withColumn("_loose", part(F.xxhash64("task_id"))), ["task_id", "_loose"], how).drop("_loose")


def refresh_items(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """Items take their task's state; a missing task fails them, items without task stay."""
    rows = _dealt(items, tasks.select("task_id", F.col("state").alias("now")), "left")
    lost = F.col("task_id").isNotNull() & F.col("now").isNull()
    return rows.select(
        "batch_id", "idx", F.when(lost, "failed").otherwise(F.coalesce("now", "state")).alias("state"), F.when(lost, "TASK_MISSING").alias("error"),
    )


def batch_summary(items: DataFrame, tasks: DataFrame) -> DataFrame:
    rows = _dealt(items, tasks.select("task_id", "reviewed_revision"), "left")
    has = F.col("task_id").isNotNull() & F.col("reviewed_revision").isNotNull()
    return rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(has & (F.col("reviewed_revision") > 0)).alias("reviewed"),
        F.count_if(has & (F.col("state") == "awaiting_review") & (F.col("reviewed_revision") == 0)).alias("awaiting"), F.count_if(F.col("state") == "failed").alias("failed"),
    )


def state_after_analysis(items: DataFrame) -> DataFrame:
    some = F.bool_or(F.col("state") == "awaiting_review")
    return items.groupBy("batch_id").agg(F.when(some, "awaiting_review").otherwise("failed").alias("state"), F.when(~some, "BATCH_ANALYSIS_FAILED").alias("error"))


def state_after_execute(items: DataFrame) -> DataFrame:
    done, n = F.count_if(F.col("state") == "completed"), F.count(F.lit(1))
    return items.groupBy("batch_id").agg(F.when(done == n, "completed").when(done > 0, "partial").otherwise("failed").alias("state"))


def recover_interrupted(tasks: DataFrame) -> DataFrame:
    """Tasks that were running when the process ended have failed and may be retried."""
    hit = F.col("state").isin("queued", "analyzing", "processing")
    return tasks.withColumn("error", F.when(hit, "INTERRUPTED")).withColumn("retryable", hit).withColumn("state", F.when(hit, "failed").otherwise(F.col("state")))


def error_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERRORS, "code string, recovery_action string, retryable boolean")


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "from_state string, to_state string")


def transition_audit(log: DataFrame) -> DataFrame:
    """Changes of a job's log (job_id, seq, state) that are not legal."""
    moves = log.withColumn("from_state", F.lag("state").over(Window.partitionBy("job_id").orderBy("seq"))).where("from_state is not null")
    moves = moves.withColumnRenamed("state", "to_state")
    return moves.join(F.broadcast(transitions(log.sparkSession)), ["from_state", "to_state"], "left_anti").select("job_id", "seq", "from_state", "to_state")


def latest_snapshot(log: DataFrame) -> DataFrame:
    """Last state of each job, and the place of its first terminal update (its finish)."""
    ended = F.min(F.when(F.col("state").isin(TERMINAL), F.col("seq")))
    return log.groupBy("job_id").agg(F.max_by("state", "seq").alias("state"), ended.alias("finish_seq"), F.min(F.when(F.col("state").isin(TERMINAL), F.col("ts"))).alias("finished_at"))


def retained_jobs(jobs: DataFrame, most: int = 256) -> DataFrame:
    """All unfinished jobs and the ``most`` finished last. A bounded top-k, so no sort of
    all jobs in one task."""
    ended = jobs.where("finished_at is not null")
    last = ended.orderBy(F.desc("finished_at"), F.desc("job_id")).limit(most)
    return jobs.where("finished_at is null").unionByName(last)


def unique_export_names(items: DataFrame) -> DataFrame:
    """Names of completed items, unique without case: later equal ones get " (2)", ..."""
    name = F.when(F.coalesce("display_name", F.lit("")) == "", F.concat(F.lit("第"), (F.col("idx") + 1).cast("string"), F.lit("个文件"))).otherwise(F.col("display_name"))
    rows = items.where("state = 'completed'").withColumn("_name", name)
    of = stem(F.col("_name"))
    ext = F.lower(F.left(F.regexp_replace(F.coalesce("output_extension", F.lit("")), "[^A-Za-z0-9]", ""), F.lit(16)))
    rows = rows.withColumn("_stem", F.when(of == "", NO_STEM).otherwise(of)).withColumn("_ext", F.when(ext == "", "bin").otherwise(ext))
    n = F.row_number().over(Window.partitionBy("batch_id", F.lower("_stem"), "_ext").orderBy("idx"))
    serial = F.when(n > 1, F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise("")
    return rows.select("batch_id", "idx", F.concat("_stem", F.lit(SUFFIX), serial, F.lit("."), "_ext").alias("export_name"))


def publish_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Free names for rows (folder, stem, seq): serials not among ``existing`` (folder,
    stem, serial), lowest first, in order of seq."""
    key = ["folder", "stem"]
    need = wanted.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    used = existing.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    # among the first n + m serials at least n are free
    spare = need.join(used, key, "left").select(*key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + F.coalesce("m", F.lit(0)))).alias("serial"))
    free = spare.join(existing, [*key, "serial"], "left_anti")
    free = free.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("serial")))
    ranked = wanted.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("seq")))
    name = F.when(F.col("serial") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit(" ("), F.col("serial").cast("string"), F.lit(")")))
    return ranked.join(free, [*key, "k"]).select("folder", "seq", name.alias("name"))


def delete_tasks(tasks: DataFrame, ids: DataFrame, *owned: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Tasks and what they own without the deleted ones; running tasks are refused."""
    asked = tasks.join(ids, "task_id", "left_semi")
    busy = asked.where("state in ('queued', 'analyzing', 'processing')")
    gone = asked.join(busy.select("task_id"), "task_id", "left_anti").select("task_id")
    return tasks.join(gone, "task_id", "left_anti"), [_dealt(o, gone, "left_anti") for o in owned], busy.select("task_id", F.lit("INVALID_TASK_STATE").alias("error"))


TASK_SCHEMA = "task_id long, state string, revision int, reviewed_revision int, created_at long, page_count int, _corrupt_record string"


def task_log(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Task records from rows (id, metadata JSON): readable ones with defaults for missing
    fields, and a quarantine of broken ones or of those whose id is another's."""
    parsed = rows.withColumn("m", F.from_json("metadata", TASK_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    reason = F.when(F.col("m._corrupt_record").isNotNull() | F.col("m").isNull(), "UNREADABLE").when(~F.col("m.task_id").eqNullSafe(F.col("id")), "WRONG_ID")
    parsed = parsed.withColumn("reason", reason)
    good = parsed.where("reason is null").select(
        "m.task_id", F.coalesce("m.state", F.lit("queued")).alias("state"), F.coalesce("m.revision", F.lit(0)).alias("revision"),
        F.coalesce("m.reviewed_revision", F.lit(0)).alias("reviewed_revision"), F.coalesce("m.created_at", F.lit(0)).alias("created_at"), F.coalesce("m.page_count", F.lit(0)).alias("page_count"),
    )
    return good, parsed.where("reason is not null").select("id", "reason")
