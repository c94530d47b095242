"""Inputs derived from the base tables: one SQL text each, run by Spark and by the oracle."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

DERIVED: dict[str, str] = {
    # contact texts with a phone, an id card, an e-mail, sometimes an emoji or a long digit run
    "contacts": """
SELECT c_custkey AS doc_id,
  '客户' || c_name || '，电话1' || CAST(3 + c_custkey % 7 AS STRING) || lpad(CAST(c_custkey AS STRING), 9, '0')
  || '，身份证11010119900' || CAST(1 + c_custkey % 9 AS STRING) || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')
  || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || 'X，邮箱user' || CAST(c_custkey AS STRING) || '@example.com'
  || CASE WHEN c_custkey % 7 = 0 THEN '😀' ELSE '' END
  || CASE WHEN c_custkey % 11 = 0 THEN ' 13' || lpad(CAST(c_custkey AS STRING), 10, '0') ELSE '' END AS text
FROM {customer}""",
    "texts": "SELECT doc_id, text FROM {documents}",
    "spans": """
SELECT l_orderkey AS doc_id,
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS INT) AS STRING) AS entity_id,
  CASE l_linenumber % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'PHONE' WHEN 2 THEN 'EMAIL' WHEN 3 THEN 'ORGANIZATION' ELSE 'PROJECT' END AS entity_type,
  CAST(round(1.05 - 11 * l_discount, 2) AS DOUBLE) AS score,
  CASE WHEN l_returnflag = 'N' THEN 'model' ELSE 'rule' END AS source,
  CAST(l_linenumber AS INT) AS detector_order,
  CAST(l_partkey % 80 AS INT) AS start_at, CAST(l_partkey % 80 + 1 + CAST(l_quantity AS INT) % 12 AS INT) AS end_at
FROM {lineitem}""",
    "span_texts": """
SELECT o_orderkey AS doc_id, rpad(o_orderpriority || ' 订单' || CAST(o_orderkey AS STRING) || ' ' || o_orderstatus || ' ', 70 + CAST(o_orderkey % 40 AS INT), 'abcdefg 某公司hij') AS text
FROM {orders}""",
    "decisions": """
SELECT entity_id, doc_id, detector_order % 2 = 0 AS selected,
  CASE WHEN start_at % 3 = 0 THEN 'R' || CAST(start_at AS STRING) WHEN start_at % 41 = 1 THEN rpad('x', 5000, 'x') END AS replacement
FROM {spans} WHERE start_at % 5 = 0
UNION ALL SELECT entity_id || '-foreign', doc_id, true, CAST(NULL AS STRING) FROM {spans} WHERE doc_id % 97 = 0
UNION ALL SELECT entity_id, doc_id, true, CAST(NULL AS STRING) FROM {spans} WHERE doc_id % 89 = 0 AND start_at % 5 = 0""",
    "policies": """
SELECT * FROM (VALUES ('PHONE', '[电话]'), ('PROJECT', '[项目]'), ('BANK_CARD', '[卡号]')) AS t(entity_type, replacement)""",
    "rules": r"""
SELECT * FROM (VALUES
  (1, 'card', 'BANK_CARD', 'regex', '[0-9]{16}', true),
  (2, 'address', 'IPV4', 'regex', '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}', true),
  (3, 'product', 'PRODUCT', 'literal', 'MIT License.', true),
  (4, 'terms', 'TERM', 'dictionary', 'tion' || chr(13) || chr(10) || 'tionti' || chr(10) || ' anan ' || chr(9) || chr(10) || chr(10) || 'license' || chr(10) || 'e | t' || chr(13) || chr(10) || 'license', true),
  (5, 'off', 'OFF', 'literal', 'the', false)) AS t(rule_id, name, entity_type, kind, pattern, enabled)""",
    "fragments": """
SELECT conv_id AS doc_id, CAST(turn AS INT) AS frag_no, coalesce(text, '') AS text FROM {conversations}""",
    "slices": """
SELECT doc_id, i AS frag_no, substring(text, i * 13 + 1, 13) AS text
FROM (SELECT doc_id, text, explode(sequence(0, CAST(floor((char_length(text) - 1) / 13) AS INT))) AS i FROM {contacts}) t""",
    "tasks": """
SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey END AS parent_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'processing' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'analyzing' WHEN 2 THEN 'awaiting_review' ELSE 'failed' END END AS state,
  CAST(o_orderkey % 3 AS INT) AS revision, CAST(o_orderkey % 2 AS INT) AS reviewed_revision,
  CAST(datediff(CAST(o_orderdate AS DATE), DATE '1970-01-01') AS BIGINT) * 86400 AS created_at
FROM {orders}""",
    "files": """
SELECT l_orderkey AS batch_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax) - 1 AS INT) AS idx,
  CASE WHEN l_partkey % 3 = 0 THEN 'C:' || chr(92) || 'Docs' || chr(92) ELSE '/data/in/' END || CASE l_partkey % 7 WHEN 0 THEN 'Report' WHEN 1 THEN 'report' WHEN 2 THEN 'CON' WHEN 3 THEN 'a<b>:c' WHEN 4 THEN '' ELSE 'file' || CAST(l_partkey % 20 AS STRING) END
  || CASE l_suppkey % 6 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' WHEN 2 THEN '.exe' WHEN 3 THEN '' WHEN 4 THEN '.docx' ELSE '.pdf ' END AS path,
  CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE CAST(floor(l_extendedprice * 1000) AS BIGINT) END AS size_bytes
FROM {lineitem}""",
    "batch_items": """
SELECT batch_id, idx, CASE WHEN idx % 4 = 3 THEN NULL ELSE batch_id END AS task_id,
  CASE (batch_id + idx) % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'awaiting_review' ELSE 'completed' END AS state, path
FROM {files}""",
    "state_log": """
SELECT user_id AS job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, ts,
  CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'queued' WHEN 1 THEN 'analyzing' WHEN 2 THEN 'awaiting_review' WHEN 3 THEN 'processing' WHEN 4 THEN 'completed'
    WHEN 5 THEN 'analyzing' WHEN 6 THEN 'failed' WHEN 7 THEN 'processing' ELSE 'partial' END AS state
FROM {events}""",
    # page lines on a grid, with a quadrilateral
    "lines": """
SELECT doc_id, page, line_id, text, score, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM (
  SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INT) AS page,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax) AS INT) AS line_id,
    CASE WHEN l_partkey % 11 = 0 THEN '  ' ELSE '行' || l_linestatus || CAST(l_partkey AS STRING) || CASE WHEN l_partkey % 6 = 0 THEN chr(10) ELSE '' END END AS text,
    CAST(1 - 5 * l_tax * 2 AS DOUBLE) AS score,
    CAST(l_partkey % 60 AS DOUBLE) / 100 AS x0, CAST(l_suppkey % 9 AS DOUBLE) / 10 AS y0,
    CAST(l_quantity AS DOUBLE) / 200 + 0.01 AS w, CAST(l_linenumber AS DOUBLE) / 100 AS h FROM {lineitem}) t""",
    "regions": """
SELECT doc_id, line_id AS region_id, page, CASE WHEN line_id % 2 = 0 THEN 'manual' ELSE 'ocr' END AS source, text,
  x0, y0, CASE WHEN line_id % 5 = 0 THEN x0 WHEN line_id % 7 = 0 THEN x1 + 1 ELSE x1 END AS x1, y1, CAST(doc_id % 3 AS INT) AS revision
FROM {lines}""",
    "emissions": """
SELECT vec_id AS seq_id, pos, CAST(round(e[pos * 4 + 0 + {base}], 4) AS DOUBLE) * 10 + 0.0 AS e0, CAST(round(e[pos * 4 + 1 + {base}], 4) AS DOUBLE) * 10 + 0.0 AS e1,
  CAST(round(e[pos * 4 + 2 + {base}], 4) AS DOUBLE) * 10 + 0.0 AS e2, CAST(round(e[pos * 4 + 3 + {base}], 4) AS DOUBLE) * 10 + 0.0 AS e3
FROM (SELECT vec_id, embedding AS e, explode(sequence(0, CAST(floor(size(embedding) / 4) AS INT) - 1)) AS pos FROM {embeddings}) t""",
    "manifest": """
SELECT 'Doc-' || CAST(doc_id AS STRING) AS name, CAST(octet_length(text) AS BIGINT) AS size_bytes, sha2(text, 256) AS sha256 FROM {documents}
UNION ALL SELECT 'DOC-' || CAST(doc_id AS STRING), CAST(octet_length(text) AS BIGINT), sha2(text, 256) FROM {documents} WHERE doc_id % 50 = 19
UNION ALL SELECT 'dir/' || CAST(doc_id AS STRING), CAST(5 AS BIGINT), sha2(text, 256) FROM {documents} WHERE doc_id % 50 = 21""",
    "files_seen": """
SELECT CASE WHEN doc_id % 50 = 3 THEN 'DOC-' ELSE 'Doc-' END || CAST(doc_id AS STRING) || CASE WHEN doc_id % 50 = 7 THEN '-extra' ELSE '' END AS name,
  CASE WHEN doc_id % 50 = 9 THEN text || '!' WHEN doc_id % 50 = 11 THEN lower(text) ELSE text END AS content
FROM {documents} WHERE doc_id % 50 <> 13
UNION ALL SELECT 'doc-' || CAST(doc_id AS STRING), text FROM {documents} WHERE doc_id % 50 = 17""",
}

#: What differs for the oracle's dialect, as plain replacements.
DIALECT = [
    ("explode(sequence(0, CAST(floor((char_length(text) - 1) / 13) AS INT)))", "unnest(range(0, CAST(floor((char_length(text) - 1) / 13) AS INT) + 1))::INT"),
    ("explode(sequence(0, CAST(floor(size(embedding) / 4) AS INT) - 1))", "unnest(range(0, len(embedding) // 4))::INT"),
    ("octet_length(text)", "strlen(text)"),
    ("sha2(text, 256)", "sha256(text)"),
    ("datediff(CAST(o_orderdate AS DATE), DATE '1970-01-01')", "datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"),
    (" AS INT)", " AS INTEGER)"),
]


def spread(df: DataFrame) -> DataFrame:
    """The same rows dealt out to all cores if fewer tasks than that would have any: a file
    is cut by bytes, but the rows of a row group are all of one task, so of a table of one
    group one task does all the work, however many there are. Tables of many groups stay as
    they are, without a shuffle. To tell, only the files' footers are read."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.select(F.spark_partition_id()).distinct().count() >= cores else df.repartition(cores)


#: Rows that one part of a shuffle by key is to hold, about.
ROWS_A_PART = 1 << 19


def dealt(df: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` into as many parts as the rows of the stored ``table`` it
    is made of need, and no fewer than the session's: what a task sorts or gathers does not
    grow with the table. To count rows, only the files' footers are read."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // ROWS_A_PART)), *keys)


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, which a
    cluster must name, or in a single JVM without one below the warehouse."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/desense-{uuid.uuid4().hex}"


def _needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{([a-z_]+)\}", sql)) if n != "base"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived input. Contacts, which many detectors search, are dealt out
    to all cores, and rows that lines are numbered from by document."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "contacts":
        return spread(_derived(spark, sf_dir, name))
    return _derived(spark, sf_dir, name)


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = DERIVED[name].replace("{base}", "0")
    frames = {}
    for need in _needs(sql):
        frame = load(spark, sf_dir, need)
        frames[f"in_{need}"] = dealt(frame, frame, "l_orderkey") if name == "lines" else frame
        sql = sql.replace("{" + need + "}", f"\0in_{need}\1")
    sql = sql.replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}")
    return spark.sql(sql, **frames) if frames else spark.sql(sql.replace("{{", "{").replace("}}", "}"))


def oracle(sql: str, *inputs: str) -> str:
    """The oracle's SQL with the inputs it names as common table expressions."""
    ctes: dict[str, str] = {}

    def add(name: str) -> None:
        if name in BASE or name in ctes:
            return
        text = DERIVED[name].replace("{base}", "1")
        for need in _needs(text):
            add(need)
            text = text.replace("{" + need + "}", need)
        for spark_text, duck_text in DIALECT:
            text = text.replace(spark_text, duck_text)
        ctes[name] = text

    for name in inputs:
        add(name)
    head = ", ".join(f"{n} AS ({t})" for n, t in ctes.items())
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE'):]}" if head else body
    if body.upper().startswith("WITH"):
        return f"WITH {head}, {body[len('WITH'):]}" if head else body
    return f"WITH {head} {body}" if head else body
