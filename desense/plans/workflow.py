"""Queries of ingest, review, regions, tasks, batches and sequences, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from desense.functions import geometry
from desense.functions.replacement import DEFAULT_SQL, GENERIC
from desense.operators import audit, edits, review, sequence, tasks
from desense.operators.spans import default_selection
from desense.sources import sinks
from desense.sources.inputs import dealt, load, oracle, workspace
from desense.sources.store import Conflict, Store

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None, *inputs: str):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = oracle(sql, *inputs)
        return f

    return register


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# --- ingest, names ---------------------------------------------------------------------

_FILE = r"regexp_extract(path, '[^/\\]*$')"
_EXT = rf"lower(regexp_extract({_FILE}, '^.+\.([A-Za-z0-9]{{1,16}})$', 1))"


_TEXT_BYTES = "CASE WHEN idx % 5 = 3 THEN 0 WHEN idx % 5 <> 4 THEN size_bytes % 12000000 END"


@query("ingest_admission", f"""SELECT batch_id, idx, ext, CASE WHEN ext = '' THEN 'NO_EXTENSION' WHEN ext NOT IN {_in(tasks.EXTENSIONS)} THEN 'UNSUPPORTED_FORMAT'
  WHEN coalesce(size_bytes, 0) > {tasks.MOST_FILE_BYTES} THEN 'TOO_LARGE' WHEN text_bytes = 0 THEN 'EMPTY_TEXT' WHEN text_bytes > {tasks.MOST_TEXT_BYTES} THEN 'TEXT_TOO_LARGE' END AS reject_code
FROM (SELECT *, {_EXT} AS ext, {_TEXT_BYTES} AS text_bytes FROM files)""", "files")
def ingest_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "files").withColumn("text_bytes", F.expr(_TEXT_BYTES))
    return tasks.ingest_admission(files).select("batch_id", "idx", "ext", "reject_code")


def _stem(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '^.+\.') THEN regexp_replace({x}, '\.[^.]*$', '') ELSE {x} END"


@query("safe_names", rf"""WITH n AS (SELECT batch_id, idx, {_EXT} AS ext, regexp_replace(trim(left(regexp_replace({_FILE}, '[\x00-\x1F\x7F-\x{{9F}}<>:"/\\|?*]', '_', 'g'), 180)), '[. ]+$', '') AS name FROM files)
SELECT batch_id, idx, ext, CASE WHEN name = '' THEN '{tasks.NO_NAME}' WHEN upper({_stem('name')}) IN {_in(tasks.RESERVED)} THEN '_' || name ELSE name END AS name FROM n""", "files")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, p = load(spark, sf_dir, "files"), F.col("path")
    return f.select("batch_id", "idx", tasks.safe_extension(p).alias("ext"), tasks.safe_name(p).alias("name"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "tasks")
    own = F.when(F.col("task_id") % 103 == 0, F.col("task_id") + 1).otherwise(F.col("task_id"))
    record = F.to_json(F.struct(own.alias("task_id"), "state", "revision", F.when(F.col("task_id") % 4 != 0, F.col("created_at")).alias("created_at")))
    broken = F.when(F.col("task_id") % 101 == 0, F.concat(F.lit("{broken"), F.col("state"))).otherwise(record)
    return t.select(F.col("task_id").alias("id"), broken.alias("metadata"))


@query("task_log_scan", """SELECT task_id, state, revision, 0::INTEGER AS reviewed_revision, CASE WHEN task_id % 4 <> 0 THEN created_at ELSE 0 END AS created_at, 0::INTEGER AS page_count
FROM tasks WHERE task_id % 101 <> 0 AND task_id % 103 <> 0""", "tasks")
def task_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.task_log(_log(spark, sf_dir))[0].orderBy(F.desc("created_at"))


@query("quarantine_corrupt", """SELECT task_id AS id, CASE WHEN task_id % 101 = 0 THEN 'UNREADABLE' ELSE 'WRONG_ID' END AS reason FROM tasks WHERE task_id % 101 = 0 OR task_id % 103 = 0""", "tasks")
def quarantine_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.task_log(_log(spark, sf_dir))[1]


@query("task_history", "SELECT task_id, state, created_at FROM tasks WHERE parent_id IS NULL", "tasks")
def task_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "tasks").where("parent_id is null").orderBy(F.desc("created_at"), "task_id").select("task_id", "state", "created_at")


@query("pending_review", "SELECT batch_id, idx, b.task_id FROM batch_items b JOIN tasks t ON t.task_id = b.task_id WHERE reviewed_revision = 0", "batch_items", "tasks")
def pending_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "batch_items").where("task_id is not null")
    return items.join(load(spark, sf_dir, "tasks").where("reviewed_revision = 0").select("task_id"), "task_id").select("batch_id", "idx", "task_id")


# --- review ----------------------------------------------------------------------------

_BAD = """bad AS (SELECT doc_id, min(error) AS error FROM (
  SELECT doc_id, 'DUPLICATE' AS error FROM (SELECT doc_id, entity_id, count(*) AS n FROM decisions GROUP BY ALL) WHERE n > 1
  UNION ALL SELECT d.doc_id, 'FOREIGN' FROM decisions d WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = d.doc_id AND s.entity_id = d.entity_id)
  UNION ALL SELECT doc_id, 'TOO_LONG' FROM decisions WHERE strlen(replacement) > 4096) GROUP BY doc_id)"""
_APPLIED = f"""{_BAD}, good AS (SELECT * FROM decisions WHERE doc_id NOT IN (SELECT doc_id FROM bad)),
ent AS (SELECT s.doc_id, s.entity_id, s.start_at, CASE WHEN g.entity_id IS NOT NULL THEN g.selected ELSE s.score >= 0.3 END AS selected,
  CASE WHEN g.entity_id IS NOT NULL THEN g.replacement WHEN s.start_at % 10 = 0 THEN 'earlier' END AS replacement
  FROM spans s LEFT JOIN good g ON g.doc_id = s.doc_id AND g.entity_id = s.entity_id)"""


@query("decision_errors", f"WITH {_BAD} SELECT doc_id, error FROM bad", "decisions")
def decision_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.decision_errors(load(spark, sf_dir, "spans"), load(spark, sf_dir, "decisions"))


def _spans_with_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "spans").withColumn("selected", default_selection(F.col("score"))).withColumn("replacement", F.when(F.col("start_at") % 10 == 0, "earlier"))


@query("apply_decisions", f"WITH {_APPLIED} SELECT doc_id, entity_id, selected, replacement FROM ent", "decisions")
def apply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.apply_decisions(_spans_with_choice(spark, sf_dir), load(spark, sf_dir, "decisions")).select("doc_id", "entity_id", "selected", "replacement")


_MARKED = "doc_id % 3 <> 0 AS selected, CASE WHEN doc_id % 4 = 1 THEN 'mine' END AS replacement"


@query("propagate_to_regions", f"""WITH {_APPLIED}, val AS (SELECT g.doc_id, g.entity_id, g.selected, s.entity_type, s.start_at, coalesce(g.replacement, p.replacement, {DEFAULT_SQL.replace('entity_type', 's.entity_type')}) AS replacement
  FROM good g JOIN (SELECT s.*, substring(t.text, start_at + 1, end_at - start_at) AS value FROM spans s JOIN span_texts t ON t.doc_id = s.doc_id) s ON s.doc_id = g.doc_id AND s.entity_id = g.entity_id LEFT JOIN policies p ON p.entity_type = s.entity_type),
reg AS (SELECT doc_id, entity_id, start_at AS region_id, {_MARKED} FROM spans UNION ALL SELECT DISTINCT doc_id, NULL, -1, {_MARKED} FROM spans)
SELECT r.doc_id, r.region_id::INTEGER AS region_id, CASE WHEN v.entity_id IS NOT NULL THEN v.selected ELSE r.selected END AS selected, CASE WHEN v.entity_id IS NOT NULL THEN v.replacement ELSE r.replacement END AS replacement
FROM reg r LEFT JOIN val v ON v.doc_id = r.doc_id AND v.entity_id = r.entity_id""", "decisions", "span_texts", "policies")
def propagate_to_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions linked to spans, and one of each document that was marked by hand; all have
    a decision of their own."""
    s = load(spark, sf_dir, "spans")
    own = [F.expr(x).alias(n) for x, n in (part.rsplit(" AS ", 1) for part in _MARKED.split(", "))]
    linked = s.select("doc_id", "entity_id", F.col("start_at").alias("region_id"), *own)
    manual = s.select("doc_id").distinct().select("doc_id", F.lit(None).cast("string").alias("entity_id"), F.lit(-1).alias("region_id"), *own)
    value = F.substring("text", F.col("start_at") + 1, F.col("end_at") - F.col("start_at"))
    decided = review.decided_spans(_spans_with_choice(spark, sf_dir), load(spark, sf_dir, "decisions")).where("decided")
    decided = decided.join(load(spark, sf_dir, "span_texts"), "doc_id").withColumn("value", value)
    return review.propagate_to_regions(linked.unionByName(manual), decided, load(spark, sf_dir, "policies"))


_EDITS = """edits AS (SELECT CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN 'PHONE' WHEN 2 THEN ' ' ELSE p_type END AS entity_type,
  CASE WHEN p_partkey % 50 = 7 THEN rpad('x', 5000, 'x') ELSE p_name END AS replacement, p_partkey AS seq FROM part)"""


def _policy_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN 'PHONE' WHEN 2 THEN ' ' ELSE p_type END")
    return load(spark, sf_dir, "part").select(kind.alias("entity_type"), F.expr("CASE WHEN p_partkey % 50 = 7 THEN rpad('x', 5000, 'x') ELSE p_name END").alias("replacement"), F.col("p_partkey").alias("seq"))


@query("upsert_policies", f"""WITH {_EDITS}, l AS (SELECT entity_type, arg_max(replacement, seq) AS new FROM edits WHERE trim(entity_type) <> '' AND strlen(replacement) <= 4096 GROUP BY 1)
SELECT coalesce(p.entity_type, l.entity_type) AS entity_type, coalesce(new, replacement) AS replacement FROM policies p FULL JOIN l ON p.entity_type = l.entity_type""", "policies")
def upsert_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.upsert_policies(load(spark, sf_dir, "policies"), _policy_edits(spark, sf_dir))


_RULES = """old AS (SELECT p_partkey AS rule_id, p_brand AS entity_type, p_name AS pattern FROM part),
new AS (SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 7 = 0 THEN 'PERSON' ELSE p_type END AS entity_type, 'edited' AS pattern FROM part WHERE p_partkey % 5 = 0)"""


def _rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = load(spark, sf_dir, "part")
    old = p.select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("entity_type"), F.col("p_name").alias("pattern"))
    kind = F.when(F.col("p_partkey") % 7 == 0, "PERSON").otherwise(F.col("p_type"))
    return old, p.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("rule_id"), kind.alias("entity_type"), F.lit("edited").alias("pattern"))


@query("save_rules", f"WITH {_RULES} SELECT rule_id, entity_type, pattern FROM old WHERE rule_id NOT IN (SELECT rule_id FROM new) UNION ALL SELECT * FROM new")
def save_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _rules(spark, sf_dir)
    return review.save_rules(old, load(spark, sf_dir, "policies"), new)[0]


@query("save_rules_policies", f"WITH {_RULES} SELECT * FROM policies UNION ALL SELECT DISTINCT entity_type, '{GENERIC}' FROM new WHERE entity_type NOT IN {_in(review.BUILT_IN_TYPES)} AND entity_type NOT IN (SELECT entity_type FROM policies)", "policies")
def save_rules_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _rules(spark, sf_dir)
    return review.save_rules(old, load(spark, sf_dir, "policies"), new)[1]


def _rule_store(spark: SparkSession, sf_dir: str) -> Store:
    """Rules and policies as saved edits left them: one writer came first, another, who saw
    what the first saw, was refused."""
    store = Store(spark, workspace(spark))
    old, new = _rules(spark, sf_dir)
    store.commit(0, rules=old, policies=load(spark, sf_dir, "policies"))
    edits.save_rules(store, 1, new)
    try:
        edits.delete_rules(store, 1, old.select("rule_id"))
    except Conflict:
        return store
    raise AssertionError("two writers of one version")


@query("stored_rules", f"WITH {_RULES} SELECT rule_id, entity_type, pattern, 2 AS version FROM old WHERE rule_id NOT IN (SELECT rule_id FROM new) UNION ALL SELECT *, 2 FROM new UNION ALL SELECT *, 1 FROM old")
def stored_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions of the rules."""
    store = _rule_store(spark, sf_dir)
    return store.read("rules", 2).withColumn("version", F.lit(2)).unionByName(store.read("rules", 1).withColumn("version", F.lit(1)))


@query("stored_policies", f"WITH {_RULES} SELECT * FROM policies UNION ALL SELECT DISTINCT entity_type, '{GENERIC}' FROM new WHERE entity_type NOT IN {_in(review.BUILT_IN_TYPES)} AND entity_type NOT IN (SELECT entity_type FROM policies)", "policies")
def stored_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_store(spark, sf_dir).read("policies")


@query("delete_rules", f"WITH {_RULES} SELECT * FROM old WHERE rule_id NOT IN (SELECT rule_id FROM new)")
def delete_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _rules(spark, sf_dir)
    return review.delete_rules(old, new.select("rule_id"))


@query("revision_check", """SELECT o_orderkey + 1 - 1 AS task_id, CASE WHEN revision = o_orderkey % 2 THEN revision + 1 ELSE revision END::INTEGER AS revision,
  NOT coalesce(revision = o_orderkey % 2, false) AS output_valid, CASE WHEN revision IS NULL THEN 'TASK_MISSING' WHEN revision <> o_orderkey % 2 THEN 'REVISION_CONFLICT' END AS error
FROM orders o LEFT JOIN (SELECT * FROM tasks WHERE task_id % 17 <> 0) t ON t.task_id = o_orderkey""", "tasks")
def revision_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 2).cast("int").alias("expected"))
    return review.revision_check(load(spark, sf_dir, "tasks").where("task_id % 17 <> 0"), edits)


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "tasks").where("task_id % 17 <> 0")
    return t.select(F.col("task_id").alias("doc_id"), "state", "revision", "reviewed_revision", F.lit(2).alias("page_count"), F.lit(True).alias("output_valid"))


_SAVED = "SELECT task_id AS doc_id, (revision + CASE WHEN hit THEN 1 ELSE 0 END)::INTEGER AS revision, (CASE WHEN hit THEN revision + 1 ELSE reviewed_revision END)::INTEGER AS reviewed_revision, NOT hit AS output_valid FROM (SELECT *, task_id IN (SELECT doc_id FROM good) AS hit FROM tasks WHERE task_id % 17 <> 0)"
_CLOSED = """rv AS (SELECT * FROM tasks WHERE task_id % 17 <> 0), asked AS (SELECT DISTINCT doc_id FROM decisions),
closed AS (SELECT doc_id, CASE WHEN state IS NULL THEN 'TASK_MISSING' ELSE 'INVALID_TASK_STATE' END AS error FROM asked LEFT JOIN rv ON task_id = doc_id WHERE state IS NULL OR state <> 'awaiting_review')"""
_DECIDED = f"{_BAD}, {_CLOSED}, refused AS (SELECT * FROM closed UNION ALL SELECT * FROM bad WHERE doc_id NOT IN (SELECT doc_id FROM closed)), good AS (SELECT * FROM decisions WHERE doc_id NOT IN (SELECT doc_id FROM refused))"


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return review.save_decisions(_spans_with_choice(spark, sf_dir), load(spark, sf_dir, "decisions"), _reviews(spark, sf_dir))


@query("save_decisions", f"""WITH {_DECIDED} SELECT s.doc_id, s.entity_id, CASE WHEN g.entity_id IS NOT NULL THEN g.selected ELSE s.score >= 0.3 END AS selected,
  CASE WHEN g.entity_id IS NOT NULL THEN g.replacement WHEN s.start_at % 10 = 0 THEN 'earlier' END AS replacement FROM spans s LEFT JOIN good g ON g.doc_id = s.doc_id AND g.entity_id = s.entity_id""", "decisions", "tasks")
def save_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)[0].select("doc_id", "entity_id", "selected", "replacement")


@query("stored_decisions", f"""WITH {_DECIDED}, n AS (SELECT doc_id, count(*) AS n, count_if(g IS NOT NULL) AS hits FROM (SELECT s.doc_id, g.entity_id AS g FROM spans s LEFT JOIN good g ON g.doc_id = s.doc_id AND g.entity_id = s.entity_id) GROUP BY 1)
SELECT n.doc_id, n.n AS spans, r.revision, r.output_valid FROM n JOIN ({_SAVED}) r ON r.doc_id = n.doc_id""", "decisions", "tasks")
def stored_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and reviews after decisions were saved in the store, in one version."""
    store = Store(spark, workspace(spark))
    store.commit(0, spans=_spans_with_choice(spark, sf_dir), reviews=_reviews(spark, sf_dir))
    edits.save_decisions(store, 1, load(spark, sf_dir, "decisions"))
    spans = store.read("spans").groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"))
    return spans.join(store.read("reviews"), "doc_id").select("doc_id", "spans", "revision", "output_valid")


@query("save_decisions_reviews", f"WITH {_DECIDED} {_SAVED}", "decisions", "tasks")
def save_decisions_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)[1].select("doc_id", "revision", "reviewed_revision", "output_valid")


@query("save_decisions_errors", f"WITH {_DECIDED} SELECT doc_id, error FROM refused", "decisions", "tasks")
def save_decisions_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)[2]


_REGION_EDITS = """e AS (SELECT DISTINCT l_orderkey AS doc_id, (l_linenumber + 3)::INTEGER AS region_id, 'edited ' || l_linenumber AS text, (l_orderkey % 2)::INTEGER AS expected,
  (l_linenumber % 3)::INTEGER AS page, 0.1::DOUBLE + (l_linenumber % 4)::DOUBLE / 10 AS x1 FROM lineitem),
judged AS (SELECT e.*, CASE WHEN state IS NULL THEN 'TASK_MISSING' WHEN state <> 'awaiting_review' THEN 'INVALID_TASK_STATE' WHEN expected <> revision THEN 'REVISION_CONFLICT' END AS error
  FROM e LEFT JOIN (SELECT * FROM tasks WHERE task_id % 17 <> 0) ON task_id = doc_id)"""
_UPSERTED = f"{_REGION_EDITS}, j AS (SELECT * EXCLUDE (error), CASE WHEN error IS NULL AND (page >= 2 OR x1 < 0.15) THEN 'INVALID_REGION' ELSE error END AS error FROM judged), good AS (SELECT * FROM j WHERE error IS NULL)"
_REMOVED = f"{_REGION_EDITS}, j AS (SELECT judged.doc_id, judged.region_id, coalesce(error, CASE WHEN source IS NULL THEN 'MISSING' WHEN source <> 'manual' THEN 'NOT_MANUAL' END) AS error FROM judged LEFT JOIN regions x ON x.doc_id = judged.doc_id AND x.region_id = judged.region_id), good AS (SELECT * FROM j WHERE error IS NULL)"


def _region_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("edited "), F.col("l_linenumber").cast("string"))
    items = load(spark, sf_dir, "lineitem")
    rows = items.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") + 3).alias("region_id"), text.alias("text"), (F.col("l_orderkey") % 2).cast("int").alias("expected"),
        (F.col("l_linenumber") % 3).cast("int").alias("page"), F.lit(0.1).alias("x0"), F.lit(0.1).alias("y0"), (F.lit(0.1) + (F.col("l_linenumber") % 4).cast("double") / 10).alias("x1"), F.lit(0.2).alias("y1"),
    )
    rows = dealt(rows, items, "doc_id").distinct()
    return rows.withColumn("polygon", _polygon())


def _edited(spark: SparkSession, sf_dir: str, change) -> tuple[DataFrame, DataFrame, DataFrame]:
    regions = dealt(load(spark, sf_dir, "regions"), load(spark, sf_dir, "lineitem"), "doc_id", "region_id").withColumn("polygon", _polygon())
    return change(regions, _region_edits(spark, sf_dir), _reviews(spark, sf_dir))


@query("upsert_regions", f"""WITH {_UPSERTED} SELECT doc_id, region_id, page, 'manual' AS source, text, x1 AS right_x FROM good
UNION ALL SELECT doc_id, region_id, page, source, text, x1 FROM regions x WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.doc_id = x.doc_id AND g.region_id = x.region_id)""", "regions", "tasks")
def upsert_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, review.upsert_regions)[0].withColumn("right_x", F.col("polygon")[1]["x"]).drop("polygon")


@query("upsert_regions_reviews", f"WITH {_UPSERTED} {_SAVED}", "tasks")
def upsert_regions_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, review.upsert_regions)[1].select("doc_id", "revision", "reviewed_revision", "output_valid")


@query("upsert_regions_errors", f"WITH {_UPSERTED} SELECT doc_id, region_id, error FROM j WHERE error IS NOT NULL", "tasks")
def upsert_regions_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, review.upsert_regions)[2]


@query("remove_regions", f"WITH {_REMOVED} SELECT doc_id, region_id FROM regions x WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.doc_id = x.doc_id AND g.region_id = x.region_id)", "regions", "tasks")
def remove_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, review.remove_regions)[0].select("doc_id", "region_id")


@query("remove_regions_reviews", f"WITH {_REMOVED} {_SAVED}", "regions", "tasks")
def remove_regions_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, review.remove_regions)[1].select("doc_id", "revision", "reviewed_revision", "output_valid")


@query("remove_regions_errors", f"WITH {_REMOVED} SELECT doc_id, region_id, error FROM j WHERE error IS NOT NULL", "regions", "tasks")
def remove_regions_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, review.remove_regions)[2]


# --- regions ---------------------------------------------------------------------------

_BOX = ("x0", "y0", "x1", "y1")
_IOU = """CASE WHEN (x1 - x0) * (y1 - y0) + (hx1 - hx0) * (hy1 - hy0) - greatest(least(x1, hx1) - greatest(x0, hx0), 0) * greatest(least(y1, hy1) - greatest(y0, hy0), 0) <= 0 THEN 0
  ELSE greatest(least(x1, hx1) - greatest(x0, hx0), 0) * greatest(least(y1, hy1) - greatest(y0, hy0), 0) / ((x1 - x0) * (y1 - y0) + (hx1 - hx0) * (hy1 - hy0) - greatest(least(x1, hx1) - greatest(x0, hx0), 0) * greatest(least(y1, hy1) - greatest(y0, hy0), 0)) END"""
_HITS = "hits AS (SELECT doc_id, page, line_id AS hit_id, x0 + 0.01 AS hx0, y0 AS hy0, x1 + 0.01 AS hx1, y1 AS hy1 FROM lines WHERE line_id % 3 <> 0)"


def _polygon() -> F.Column:
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = load(spark, sf_dir, "lines").where("line_id % 3 <> 0")
    return h.select("doc_id", "page", F.col("line_id").alias("hit_id"), (F.col("x0") + 0.01).alias("hx0"), F.col("y0").alias("hy0"), (F.col("x1") + 0.01).alias("hx1"), F.col("y1").alias("hy1"))


def _iou() -> F.Column:
    return geometry.overlap_ratio(tuple(F.col(c) for c in _BOX), tuple(F.col(f"h{c}") for c in _BOX))


@query("iou", f"WITH {_HITS} SELECT l.doc_id, l.page, line_id, hit_id, round({_IOU}, 9)::DOUBLE AS ratio FROM lines l JOIN hits h ON h.doc_id = l.doc_id AND h.page = l.page", "lines")
def iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lines").join(_hits(spark, sf_dir), ["doc_id", "page"])
    return rows.select("doc_id", "page", "line_id", "hit_id", F.round(_iou(), 9).alias("ratio"))


#: Places where texts were found: some lines, some of them twice, some under another text.
_FOUND = """hits AS (SELECT doc_id, page, line_id * 2 + twice AS hit_id, CASE WHEN line_id % 5 = 2 THEN 'other' ELSE ' ' || text END AS text, x0 + 0.002 * line_id + 0.003 * twice AS hx0, y0 AS hy0, x1 + 0.002 * line_id + 0.003 * twice AS hx1, y1 AS hy1
  FROM lines CROSS JOIN (VALUES (0), (1)) t(twice) WHERE line_id % 3 <> 0 AND (twice = 0 OR line_id % 2 = 0))"""
_KEY = r"regexp_replace({}.text, '^\s+|\s+$', '', 'g')"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = load(spark, sf_dir, "lines").where("line_id % 3 <> 0").withColumn("twice", F.explode(F.when(F.col("line_id") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    by = F.lit(0.002) * F.col("line_id") + F.lit(0.003) * F.col("twice")
    text = F.when(F.col("line_id") % 5 == 2, "other").otherwise(F.concat(F.lit(" "), "text"))
    return h.select("doc_id", "page", (F.col("line_id") * 2 + F.col("twice")).alias("hit_id"), text.alias("text"), (F.col("x0") + by).alias("hx0"), F.col("y0").alias("hy0"), (F.col("x1") + by).alias("hx1"), F.col("y1").alias("hy1"))


@query("region_best_hit", f"""WITH {_FOUND}, r AS (SELECT l.doc_id, l.page, line_id AS region_id, hit_id, {_IOU} AS ratio FROM lines l LEFT JOIN hits h ON h.doc_id = l.doc_id AND h.page = l.page AND {_KEY.format('h')} = {_KEY.format('l')} AND {_KEY.format('l')} <> '')
SELECT doc_id, page, region_id, CASE WHEN max(ratio) > 0 THEN arg_max(hit_id, (ratio, hit_id)) END AS hit_id FROM r GROUP BY ALL""", "lines")
def region_best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = load(spark, sf_dir, "lines").select("doc_id", "page", F.col("line_id").alias("region_id"), "text", *_BOX)
    return review.best_hit(regions, _found(spark, sf_dir), _iou(), tuple(F.col(c) for c in _BOX), tuple(F.col(f"h{c}") for c in _BOX))


@query("validate_regions", "SELECT doc_id, region_id, page < 1 AND least(x0, y0, x1, y1) >= 0 AND greatest(x0, y0, x1, y1) <= 1 AND abs(2 * (x1 - x0) * (y1 - y0)) >= 1e-8 AS valid FROM regions", "regions")
def validate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "regions").select("doc_id", "region_id", geometry.valid_region(_polygon(), F.col("page"), F.lit(1)).alias("valid"))


@query("polygon_bounds", "SELECT doc_id, region_id, least(x0, x1) AS min_x, least(y0, y1) AS min_y, greatest(x0, x1) AS max_x, greatest(y0, y1) AS max_y FROM regions", "regions")
def polygon_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geometry.bounds(_polygon())
    return load(spark, sf_dir, "regions").select("doc_id", "region_id", *[c.alias(n) for c, n in zip(b, ("min_x", "min_y", "max_x", "max_y"), strict=True)])


def _px(v: str, n: int, f: str) -> str:
    return f"greatest(0, least({f}({v} * {n}), {n}))::INTEGER"


@query("pixel_bounds", f"""SELECT doc_id, region_id, {_px('least(x0, x1)', 1000, 'floor')} AS x, {_px('least(y0, y1)', 1400, 'floor')} AS y,
  greatest({_px('greatest(x0, x1)', 1000, 'ceil')} - {_px('least(x0, x1)', 1000, 'floor')}, 0)::INTEGER AS w, greatest({_px('greatest(y0, y1)', 1400, 'ceil')} - {_px('least(y0, y1)', 1400, 'floor')}, 0)::INTEGER AS h FROM regions""", "regions")
def pixel_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geometry.pixel_bounds(geometry.bounds(_polygon()), 1000, 1400)
    return load(spark, sf_dir, "regions").select("doc_id", "region_id", *[c.alias(n) for c, n in zip(box, "xywh", strict=True)])


@query("entity_polygon", """SELECT doc_id, line_id, round(x0 + (x1 - x0) * (1.0 / n), 9)::DOUBLE AS left_x, round(x0 + (x1 - x0) * (least(3, n) * 1.0 / n), 9)::DOUBLE AS right_x
FROM (SELECT *, length(text) AS n FROM lines)""", "lines")
def entity_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    part = geometry.span_polygon(_polygon(), n, F.lit(1.0), F.least(F.lit(3), n).cast("double"))
    rows = load(spark, sf_dir, "lines").withColumn("p", part)
    return rows.select("doc_id", "line_id", F.round(F.col("p")[0]["x"], 9).alias("left_x"), F.round(F.col("p")[1]["x"], 9).alias("right_x"))


@query("line_confidence", "SELECT doc_id, line_id FROM lines WHERE trim(text, ' ' || chr(10)) <> '' AND score >= 0.5", "lines")
def line_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lines").where(F.col("text").rlike(r"\S") & (F.col("score") >= 0.5)).select("doc_id", "line_id")


_BANDS = """s AS (SELECT *, (y0 + y1) / 2 AS cy, y1 - y0 AS h FROM lines), b AS (SELECT *, CASE WHEN cy - lag(cy) OVER w > least(h, lag(h) OVER w) / 2 THEN 1 ELSE 0 END AS brk FROM s WINDOW w AS (PARTITION BY doc_id, page ORDER BY cy, x0, line_id)),
c AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page ORDER BY cy, x0, line_id) AS band FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, x0, line_id)::INTEGER AS place FROM c)"""


@query("reading_order", f"WITH {_BANDS} SELECT doc_id, page, line_id, place FROM o", "lines")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dealt(load(spark, sf_dir, "lines"), load(spark, sf_dir, "lineitem"), "doc_id", "page")
    return review.reading_order(lines).select("doc_id", "page", "line_id", "place")


_ASSEMBLED = """seq AS (SELECT doc_id, line_id AS line_no, text FROM lines),
t AS (SELECT *, string_agg(text, '') OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM seq),
u AS (SELECT *, CASE WHEN coalesce(so_far, '') <> '' AND NOT ends_with(so_far, chr(10)) THEN 1 ELSE 0 END AS sep FROM t),
asm AS (SELECT doc_id, line_no, (sum(length(text) + sep) OVER (PARTITION BY doc_id ORDER BY line_no) - length(text))::INTEGER AS start_at, sum(length(text) + sep) OVER (PARTITION BY doc_id ORDER BY line_no)::INTEGER AS end_at FROM u)"""


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.assemble_lines(load(spark, sf_dir, "lines").select("doc_id", F.col("line_id").alias("line_no"), "text"))


@query("assemble_line_text", f"WITH {_ASSEMBLED} SELECT * FROM asm", "lines")
def assemble_line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir)


@query("line_containment", f"""WITH {_ASSEMBLED} SELECT s.doc_id, entity_id, min(line_no)::INTEGER AS line_no FROM (SELECT doc_id, entity_id, start_at % 30 AS start_at, start_at % 30 + end_at - start_at AS end_at FROM spans) s
LEFT JOIN asm a ON a.doc_id = s.doc_id AND s.start_at >= a.start_at AND s.end_at <= a.end_at GROUP BY ALL""", "lines", "spans")
def line_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "spans").select("doc_id", "entity_id", (F.col("start_at") % 30).alias("start_at"), (F.col("start_at") % 30 + F.col("end_at") - F.col("start_at")).alias("end_at"))
    return review.first_line_of(s, _assembled(spark, sf_dir))


@query("page_count", "SELECT task_id, coalesce(CASE WHEN task_id % 3 = 0 THEN 7 END, max(page) + 1)::INTEGER AS pages FROM tasks t LEFT JOIN regions r ON r.doc_id = t.task_id GROUP BY task_id", "tasks", "regions")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = load(spark, sf_dir, "regions").groupBy(F.col("doc_id").alias("task_id")).agg((F.max("page") + 1).alias("seen"))
    stored = F.when(F.col("task_id") % 3 == 0, 7)
    return load(spark, sf_dir, "tasks").join(seen, "task_id", "left").select("task_id", F.coalesce(stored, "seen").alias("pages"))


# --- audits ----------------------------------------------------------------------------


_LIMIT = 100_000


@query("integrity_audit", rf"""WITH f AS (SELECT lower(name) AS name, count(*) AS n, max(strlen(content)) AS size, max(sha256(content)) AS hash FROM files_seen GROUP BY 1),
m AS (SELECT lower(name) AS name, count(*) AS times, max(size_bytes) AS size_bytes, max(sha256) AS sha256, bool_or(name = '' OR regexp_matches(name, '[/\:]|[. ]$')) AS bad FROM manifest GROUP BY 1)
SELECT coalesce(m.name, f.name) AS name, CASE WHEN bad THEN 'bad_name' WHEN times > 1 THEN 'listed_twice' WHEN n IS NULL THEN 'missing' WHEN size_bytes IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' WHEN size <> size_bytes THEN 'size' WHEN hash <> sha256 THEN 'hash' ELSE 'ok' END AS verdict FROM m FULL JOIN f ON m.name = f.name
UNION ALL SELECT NULL, 'total_too_large' FROM manifest HAVING sum(size_bytes) > {_LIMIT}""", "manifest", "files_seen")
def integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.integrity_audit(load(spark, sf_dir, "manifest"), load(spark, sf_dir, "files_seen"), _LIMIT)


def _actual(s: DataFrame) -> DataFrame:
    k = F.col("start_at") % 20
    out = s.where(k != 3).withColumn("score", F.when(k == 5, F.col("score") + 0.5).otherwise(F.col("score")))
    return out.withColumn("entity_type", F.when(k == 9, "OTHER").otherwise(F.col("entity_type"))).withColumn("end_at", F.when(k == 7, F.col("end_at") + 100).otherwise(F.col("end_at")))


@query("annotation_diff", """WITH a AS (SELECT doc_id, entity_id, start_at, CASE WHEN start_at % 20 = 7 THEN end_at + 100 ELSE end_at END AS end_at, CASE WHEN start_at % 20 = 9 THEN 'OTHER' ELSE entity_type END AS entity_type,
  CASE WHEN start_at % 20 = 5 THEN score + 0.5 ELSE score END AS score FROM spans WHERE start_at % 20 <> 3),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_at, end_at, entity_id)::INTEGER AS n FROM spans), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_at, end_at, entity_id)::INTEGER AS n FROM a)
SELECT * FROM (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.n, y.n) AS n, CASE WHEN x.n IS NULL OR y.n IS NULL THEN 'count' WHEN x.entity_type <> y.entity_type THEN 'type' WHEN x.start_at <> y.start_at OR x.end_at <> y.end_at THEN 'span'
  WHEN abs(x.score - y.score) > 1e-4 THEN 'score' END AS verdict FROM x FULL JOIN y ON x.doc_id = y.doc_id AND x.n = y.n) WHERE verdict IS NOT NULL""", "spans")
def annotation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "spans")
    return audit.annotation_diff(s, _actual(s))


# --- batches, tasks, jobs --------------------------------------------------------------


@query("refresh_batch_items", """SELECT batch_id, idx, CASE WHEN b.task_id IS NOT NULL AND t.task_id IS NULL THEN 'failed' ELSE coalesce(t.state, b.state) END AS state, CASE WHEN b.task_id IS NOT NULL AND t.task_id IS NULL THEN 'TASK_MISSING' END AS error
FROM batch_items b LEFT JOIN (SELECT * FROM tasks WHERE task_id % 11 <> 0) t ON t.task_id = b.task_id""", "batch_items", "tasks")
def refresh_batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.refresh_items(load(spark, sf_dir, "batch_items"), load(spark, sf_dir, "tasks").where("task_id % 11 <> 0"))


@query("interrupted_recovery", """SELECT task_id, CASE WHEN hit THEN 'failed' ELSE state END AS state, CASE WHEN hit THEN 'INTERRUPTED' END AS error, hit AS retryable FROM (SELECT *, state IN ('queued', 'analyzing', 'processing') AS hit FROM tasks)""", "tasks")
def interrupted_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.recover_interrupted(load(spark, sf_dir, "tasks")).select("task_id", "state", "error", "retryable")


_CODES = "['" + "', '".join(e[0] for e in tasks.ERRORS) + "']"


@query("error_enrich", f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in tasks.ERRORS)}) v(code, recovery_action, retryable))
SELECT event_id, e.code, recovery_action, retryable FROM (SELECT event_id, {_CODES}[event_id % 9 + 1] AS code FROM events) e LEFT JOIN c ON c.code = e.code""")
def error_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(e[0]) for e in tasks.ERRORS])
    e = load(spark, sf_dir, "events").select("event_id", F.get(codes, (F.col("event_id") % 9).cast("int")).alias("code"))
    return e.join(F.broadcast(tasks.error_catalog(spark)), "code", "left").select("event_id", "code", "recovery_action", "retryable")


@query("batch_entity_counts", """SELECT batch_id, entity_type, count(*) AS n FROM (SELECT DISTINCT batch_id, task_id FROM batch_items WHERE state = 'completed' AND task_id IS NOT NULL) b JOIN spans s ON s.doc_id = b.task_id WHERE score >= 0.3 GROUP BY ALL""", "batch_items", "spans")
def batch_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = load(spark, sf_dir, "batch_items").where("state = 'completed' and task_id is not null").select("batch_id", F.col("task_id").alias("doc_id")).distinct()
    s = load(spark, sf_dir, "spans").where(default_selection(F.col("score")))
    return done.join(s, "doc_id").groupBy("batch_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("batch_summary", """SELECT batch_id, count(*) AS total, count_if(t.task_id IS NOT NULL AND reviewed_revision > 0)::BIGINT AS reviewed, count_if(t.task_id IS NOT NULL AND b.state = 'awaiting_review' AND reviewed_revision = 0)::BIGINT AS awaiting, count_if(b.state = 'failed')::BIGINT AS failed
FROM (SELECT batch_id, idx, task_id, state FROM batch_items) b LEFT JOIN tasks t ON t.task_id = b.task_id GROUP BY batch_id""", "batch_items", "tasks")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.batch_summary(load(spark, sf_dir, "batch_items"), load(spark, sf_dir, "tasks").select("task_id", "reviewed_revision"))


@query("batch_admission", "SELECT batch_id, n, total_bytes, CASE WHEN n > 6 THEN 'TOO_MANY_FILES' WHEN total_bytes > 200000000 THEN 'TOO_LARGE' ELSE 'ok' END AS verdict FROM (SELECT batch_id, count(*) AS n, sum(coalesce(size_bytes, 0))::BIGINT AS total_bytes FROM files GROUP BY 1)", "files")
def batch_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.batch_admission(load(spark, sf_dir, "files"), 6, 200_000_000)


@query("batch_state_after_analysis", "SELECT batch_id, CASE WHEN bool_or(state = 'awaiting_review') THEN 'awaiting_review' ELSE 'failed' END AS state, CASE WHEN bool_or(state = 'awaiting_review') THEN NULL ELSE 'BATCH_ANALYSIS_FAILED' END AS error FROM batch_items GROUP BY 1", "batch_items")
def batch_state_after_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.state_after_analysis(load(spark, sf_dir, "batch_items"))


@query("batch_state_after_execute", "SELECT batch_id, CASE WHEN count_if(state = 'completed') = count(*) THEN 'completed' WHEN count_if(state = 'completed') > 0 THEN 'partial' ELSE 'failed' END AS state FROM batch_items GROUP BY 1", "batch_items")
def batch_state_after_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.state_after_execute(load(spark, sf_dir, "batch_items"))


@query("storage_usage", "SELECT conv_id AS task_id, sum(strlen(text))::BIGINT AS bytes, count(*) AS parts FROM conversations GROUP BY 1")
def storage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("task_id")).agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("parts"))


@query("acceptance_summary", f"""WITH c AS (SELECT doc_id, entity_type, count(*) AS n FROM spans GROUP BY ALL), p AS (SELECT doc_id, max(page) + 1 AS pages FROM lines GROUP BY 1),
d AS (SELECT t.doc_id, o_orderpriority AS source, CASE WHEN t.doc_id % 2 = 0 THEN 'safe' ELSE 'fidelity' END AS mode, text, coalesce(pages, 0) AS pages, t.doc_id % 1000 AS elapsed_ms FROM span_texts t JOIN orders ON o_orderkey = t.doc_id LEFT JOIN p ON p.doc_id = t.doc_id),
e AS (SELECT source, mode, '{{' || string_agg('"' || entity_type || '":' || n, ',' ORDER BY entity_type) || '}}' AS entities FROM (SELECT source, mode, entity_type, sum(n)::BIGINT AS n FROM d JOIN c ON c.doc_id = d.doc_id GROUP BY ALL) GROUP BY ALL)
SELECT d.source, d.mode, count(*) AS docs, sum(pages)::BIGINT AS pages, any_value(entities) AS entities, sha256(string_agg(sha256(text), '' ORDER BY sha256(text))) AS output_hash, sum(strlen(text))::BIGINT AS output_bytes, sum(elapsed_ms)::BIGINT AS elapsed_ms
FROM d LEFT JOIN e ON e.source = d.source AND e.mode = d.mode GROUP BY ALL""", "spans", "span_texts", "lines")
def acceptance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("source"))
    pages = load(spark, sf_dir, "lines").groupBy("doc_id").agg((F.max("page") + 1).alias("pages"))
    docs = load(spark, sf_dir, "span_texts").join(orders, "doc_id").join(pages, "doc_id", "left")
    mode = F.when(F.col("doc_id") % 2 == 0, "safe").otherwise("fidelity")
    docs = docs.select("doc_id", "source", mode.alias("mode"), "text", F.coalesce("pages", F.lit(0)).alias("pages"), (F.col("doc_id") % 1000).alias("elapsed_ms"))
    return audit.acceptance_summary(docs, load(spark, sf_dir, "spans"))


_LEGAL = ", ".join(f"('{a}', '{b}')" for a, bs in tasks.TRANSITIONS.items() for b in bs)


@query("transition_audit", f"SELECT job_id, seq, from_state, state AS to_state FROM (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY seq) AS from_state FROM state_log) WHERE from_state IS NOT NULL AND (from_state, state) NOT IN ({_LEGAL})", "state_log")
def transition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.transition_audit(load(spark, sf_dir, "state_log"))


_SNAP = f"snap AS (SELECT job_id, arg_max(state, seq) AS state, min(CASE WHEN state IN {_in(tasks.TERMINAL)} THEN seq END) AS finish_seq, min(CASE WHEN state IN {_in(tasks.TERMINAL)} THEN ts END) AS finished_at FROM state_log GROUP BY 1)"


@query("latest_job_snapshot", f"WITH {_SNAP} SELECT job_id, state, finish_seq FROM snap", "state_log")
def latest_job_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.latest_snapshot(load(spark, sf_dir, "state_log")).select("job_id", "state", "finish_seq")


@query("terminal_retention", f"WITH {_SNAP} SELECT job_id FROM snap WHERE finished_at IS NULL UNION ALL (SELECT job_id FROM snap WHERE finished_at IS NOT NULL ORDER BY finished_at DESC, job_id DESC LIMIT 20)", "state_log")
def terminal_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.retained_jobs(tasks.latest_snapshot(load(spark, sf_dir, "state_log")), 20).select("job_id")


_NAMED = r"CASE WHEN regexp_extract(path, '[^/\\]*$') = '' THEN '第' || (idx + 1) || '个文件' ELSE regexp_extract(path, '[^/\\]*$') END"


@query("unique_export_names", rf"""WITH n AS (SELECT batch_id, idx, {_NAMED} AS nm, CASE idx % 3 WHEN 0 THEN 'TXT' WHEN 1 THEN '' ELSE 'p.d-f' END AS oe FROM batch_items WHERE state = 'completed'),
s AS (SELECT *, CASE WHEN {_stem('nm')} = '' THEN '{tasks.NO_STEM}' ELSE {_stem('nm')} END AS st, CASE idx % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'bin' ELSE 'pdf' END AS ex FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY batch_id, lower(st), ex ORDER BY idx) AS c FROM s)
SELECT batch_id, idx, st || '{tasks.SUFFIX}' || CASE WHEN c > 1 THEN ' (' || c || ')' ELSE '' END || '.' || ex AS export_name FROM k""", "batch_items")
def unique_export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = load(spark, sf_dir, "batch_items").withColumn("display_name", tasks.file_name(F.col("path")))
    ext = F.when(F.col("idx") % 3 == 0, "TXT").when(F.col("idx") % 3 == 1, "").otherwise("p.d-f")
    return tasks.unique_export_names(b.withColumn("output_extension", ext))


@query("publish_names", """WITH w AS (SELECT c_nationkey AS folder, c_mktsegment AS stem, c_custkey AS seq FROM customer), e AS (SELECT DISTINCT s_nationkey AS folder, 'BUILDING' AS stem, 1 + s_suppkey % 7 AS serial FROM supplier),
n AS (SELECT folder, stem, count(*) AS n FROM w GROUP BY ALL), m AS (SELECT folder, stem, count(*) AS m FROM e GROUP BY ALL), sp AS (SELECT n.folder, n.stem, unnest(range(1, n + coalesce(m, 0) + 1)) AS serial FROM n LEFT JOIN m ON n.folder = m.folder AND n.stem = m.stem),
f AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY serial) AS k FROM sp WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.folder = sp.folder AND e.stem = sp.stem AND e.serial = sp.serial)), r AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY seq) AS k FROM w)
SELECT r.folder, seq, r.stem || CASE WHEN serial > 1 THEN ' (' || serial || ')' ELSE '' END AS name FROM r JOIN f ON r.folder = f.folder AND r.stem = f.stem AND r.k = f.k""")
def publish_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("folder"), F.col("c_mktsegment").alias("stem"), F.col("c_custkey").alias("seq"))
    e = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("folder"), F.lit("BUILDING").alias("stem"), (1 + F.col("s_suppkey") % 7).alias("serial")).distinct()
    return tasks.publish_names(w, e)


@query("delete_tasks", "SELECT task_id FROM tasks WHERE NOT (task_id % 3 = 0 AND state NOT IN ('queued', 'analyzing', 'processing'))", "tasks")
def delete_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "tasks")
    return tasks.delete_tasks(t, t.where("task_id % 3 = 0").select("task_id"))[0].select("task_id")


@query("delete_tasks_owned", "SELECT batch_id, idx FROM batch_items b WHERE b.task_id IS NULL OR b.task_id NOT IN (SELECT task_id FROM tasks WHERE task_id % 3 = 0 AND state NOT IN ('queued', 'analyzing', 'processing'))", "tasks", "batch_items")
def delete_tasks_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "tasks")
    return tasks.delete_tasks(t, t.where("task_id % 3 = 0").select("task_id"), load(spark, sf_dir, "batch_items"))[1][0].select("batch_id", "idx")


@query("write_report", """SELECT '{"version":1,"job_id":' || o.task_id || ',"kind":"' || CASE WHEN parent_id IS NULL THEN 'file' ELSE 'batch' END || '","state":"' || state || '","entity_counts":{' || coalesce(string_agg('"' || entity_type || '":' || n, ',' ORDER BY entity_type), '') || '}'
  || CASE WHEN state = 'completed' THEN ',"output_path":"out/' || o.task_id || '.txt"' ELSE '' END || '}' AS report
FROM tasks o LEFT JOIN (SELECT doc_id, entity_type, count(*) AS n FROM spans WHERE score >= 0.3 GROUP BY ALL) c ON c.doc_id = o.task_id GROUP BY o.task_id, parent_id, state""", "tasks", "spans")
def write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One counts-only JSON report for each task, written and read back; never text or values."""
    counts = load(spark, sf_dir, "spans").where(default_selection(F.col("score"))).groupBy(F.col("doc_id").alias("job_id"), "entity_type").agg(F.count(F.lit(1)).alias("n"))
    kind, path = F.when(F.col("parent_id").isNull(), "file").otherwise("batch"), F.when(F.col("state") == "completed", F.concat(F.lit("out/"), "task_id", F.lit(".txt")))
    jobs = load(spark, sf_dir, "tasks").select(F.col("task_id").alias("job_id"), kind.alias("kind"), "state", path.alias("output_path"))
    out = workspace(spark)
    sinks.write_report(sinks.reports(jobs, counts), out)
    return spark.read.text(out).withColumnRenamed("value", "report")


# --- sequences -------------------------------------------------------------------------

START, END = [0.0, 0.1, -0.2, 0.05], [0.0, -0.1, 0.3, 0.0]
MOVES = [[0.2, 0.1, -1.0, -1.0], [-0.5, -1.0, 0.8, 0.6], [-0.4, -1.0, 0.5, 0.7], [0.3, 0.2, -1.0, -1.0]]
TAGS = ["O", "B-PER", "I-PER", "E-PER"]


def _viterbi_sql() -> str:
    def best(j: int) -> str:
        return "greatest(" + ", ".join(f"s{i} + {MOVES[i][j]}" for i in range(4)) + ")"

    def back(j: int) -> str:
        return "CASE " + " ".join(f"WHEN s{i} + {MOVES[i][j]} = {best(j)} THEN {i}" for i in range(4)) + " END"

    first = ", ".join(f"e{i} + {START[i]}::DOUBLE AS s{i}" for i in range(4))
    nxt = ", ".join(f"{best(j)} + m.e{j}" for j in range(4))
    final = "CASE " + " ".join(f"WHEN s{i} + {END[i]} = greatest({', '.join(f's{k} + {END[k]}' for k in range(4))}) THEN {i}" for i in range(4)) + " END"
    return f"""WITH RECURSIVE fw AS (SELECT seq_id, pos, {first}, 0 AS b0, 0 AS b1, 0 AS b2, 0 AS b3 FROM emissions WHERE pos = 0
  UNION ALL SELECT m.seq_id, m.pos, {nxt}, {', '.join(back(j) for j in range(4))} FROM fw JOIN emissions m ON m.seq_id = fw.seq_id AND m.pos = fw.pos + 1),
bw AS (SELECT seq_id, pos, {final} AS tag, b0, b1, b2, b3 FROM fw WHERE pos = (SELECT max(m.pos) FROM fw m WHERE m.seq_id = fw.seq_id)
  UNION ALL SELECT f.seq_id, f.pos, CASE bw.tag WHEN 0 THEN bw.b0 WHEN 1 THEN bw.b1 WHEN 2 THEN bw.b2 ELSE bw.b3 END, f.b0, f.b1, f.b2, f.b3 FROM bw JOIN fw f ON f.seq_id = bw.seq_id AND f.pos = bw.pos - 1)"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "emissions").select("seq_id", "pos", F.array("e0", "e1", "e2", "e3").alias("values"))
    return sequence.decode_tag_path(e, START, END, MOVES).join(e, ["seq_id", "pos"])


@query("decode_tag_path", _viterbi_sql() + " SELECT seq_id, pos, tag::INTEGER AS tag FROM bw", "emissions")
def decode_tag_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("seq_id", "pos", "tag")


_SOFT = "exp([e0, e1, e2, e3][{t} + 1] - greatest(e0, e1, e2, e3)) / (exp(e0 - greatest(e0, e1, e2, e3)) + exp(e1 - greatest(e0, e1, e2, e3)) + exp(e2 - greatest(e0, e1, e2, e3)) + exp(e3 - greatest(e0, e1, e2, e3)))"


@query("softmax_score", f"SELECT seq_id, pos, round({_SOFT.format(t='pos % 4')}, 6)::DOUBLE AS p FROM emissions", "emissions")
def softmax_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "emissions")
    return e.select("seq_id", "pos", F.round(sequence.softmax(F.array("e0", "e1", "e2", "e3"), F.col("pos") % 4), 6).alias("p"))


@query("assemble_tag_spans", _viterbi_sql() + f""", tg AS (SELECT e.*, bw.tag, round({_SOFT.format(t='bw.tag')}, 6) AS score FROM bw JOIN emissions e ON e.seq_id = bw.seq_id AND e.pos = bw.pos),
nz AS (SELECT *, CASE WHEN tag = 1 OR coalesce(lag(tag) OVER (PARTITION BY seq_id ORDER BY pos) = 3, true) THEN 1 ELSE 0 END AS op FROM tg WHERE tag <> 0),
isl AS (SELECT *, sum(op) OVER (PARTITION BY seq_id ORDER BY pos) AS n FROM nz)
SELECT seq_id, 'PERSON' AS entity_type, (min(pos) * 2)::INTEGER AS start_at, (max(pos) * 2 + 2)::INTEGER AS end_at, arg_min(score, pos)::DOUBLE AS score FROM isl GROUP BY seq_id, n""", "emissions")
def assemble_tag_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir)
    label = F.get(F.array(*[F.lit(t) for t in TAGS]), F.col("tag"))
    score = F.round(sequence.softmax(F.col("values"), F.col("tag")), 6)
    tags = rows.select("seq_id", "pos", label.alias("label"), score.alias("score"), (F.col("pos") * 2).alias("start_at"), (F.col("pos") * 2 + 2).alias("end_at"))
    return sequence.assemble_tag_spans(tags)
