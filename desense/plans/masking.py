"""Queries of detection, span sets and redaction, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from desense.functions.replacement import BUILT_IN, DEFAULT_SQL, LABEL_SQL, default_replacement, type_label
from desense.operators import audit, detect, onepass, redact, spans
from desense.sources.inputs import dealt, load, oracle, spread

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None, *inputs: str):
    """Register a query, and its oracle over the named inputs."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = oracle(sql, *inputs)
        return f

    return register


def detected_sql(docs: str, kinds: str = "built-in rule", out: str = "det") -> str:
    """Common table expressions that end in ``out``, the spans of ``docs``."""
    built = ", ".join(f"({i + 1}, '{t}', '{p}', {s}::DOUBLE, {str(not d).lower()}, 'built-in')" for i, (t, p, s, d) in enumerate(detect.PATTERNS))
    parts = [f"SELECT * FROM (VALUES {built}) AS v(detector_order, entity_type, pattern, score, no_digit, source)"] if "built-in" in kinds else []
    if "rule" in kinds:
        parts.append(r"""SELECT 100 + rule_id AS detector_order, entity_type, CASE WHEN kind = 'regex' THEN term ELSE regexp_escape(term) END AS pattern, 1.0::DOUBLE AS score, false AS no_digit, 'custom rule' AS source
  FROM (SELECT rule_id, entity_type, kind, unnest(CASE WHEN kind = 'dictionary' THEN list_distinct(list_filter(list_transform(string_split_regex(pattern, '\r?\n'), lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: t <> '')) ELSE [pattern] END) AS term FROM rules WHERE enabled)""")
    return f"""{out}_p AS ({' UNION ALL '.join(parts)}),
{out}_m AS (SELECT d.doc_id, d.text, p.*, regexp_extract_all(d.text, p.pattern) AS v, string_split_regex(d.text, p.pattern) AS g FROM {docs} d JOIN {out}_p p ON regexp_matches(d.text, p.pattern)),
{out}_x AS (SELECT *, unnest(v) AS value, unnest(range(1, len(v) + 1)) AS i FROM {out}_m),
{out}_y AS (SELECT *, (list_sum(list_transform(g[1:i], lambda q: length(q))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda q: length(q))), 0))::INTEGER AS start_at FROM {out}_x WHERE value <> ''),
{out} AS (SELECT doc_id, entity_type, value, start_at, (start_at + length(value))::INTEGER AS end_at, score, source, detector_order::INTEGER AS detector_order FROM {out}_y
  WHERE NOT (no_digit AND (regexp_matches(CASE WHEN start_at > 0 THEN substring(text, start_at, 1) ELSE '' END, '^[0-9]$') OR regexp_matches(substring(text, start_at + length(value) + 1, 1), '^[0-9]$'))))"""


def resolved_sql(source: str, bytes_sql: str = "strlen(value)", out: str = "res") -> str:
    """``out``: the spans of ``source`` (with entity_id) that a greedy pass keeps."""
    return f"""{out}_r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, {bytes_sql} DESC, start_at, entity_type, detector_order, entity_id) AS rn
  FROM {source} WHERE NOT isnan(score) AND score BETWEEN 0 AND 1 AND start_at < end_at),
{out}_w(doc_id, rn, taken) AS (SELECT doc_id, rn, [{{'s': start_at, 'e': end_at, 'id': entity_id}}] FROM {out}_r WHERE rn = 1
  UNION ALL SELECT r.doc_id, r.rn, CASE WHEN len(list_filter(w.taken, lambda t: t.s < r.end_at AND r.start_at < t.e)) > 0 THEN w.taken
    ELSE list_append(w.taken, {{'s': r.start_at, 'e': r.end_at, 'id': r.entity_id}}) END
  FROM {out}_w w JOIN {out}_r r ON r.doc_id = w.doc_id AND r.rn = w.rn + 1),
{out}_k AS (SELECT doc_id, unnest(taken).id AS entity_id FROM (SELECT doc_id, arg_max(taken, rn) AS taken FROM {out}_w GROUP BY doc_id)),
{out} AS (SELECT s.* FROM {source} s SEMI JOIN {out}_k k ON s.doc_id = k.doc_id AND s.entity_id = k.entity_id)"""


IDENTIFIED = "SELECT *, sha256(concat_ws('|', doc_id, start_at, end_at, entity_type, detector_order)) AS entity_id FROM det"


def redacted_sql(docs: str, source: str, out: str = "red") -> str:
    """``out``: (doc_id, redacted, n_spans) from spans with a replacement, disjoint."""
    return f"""{out}_o AS (SELECT *, lag(end_at, 1, 0) OVER (PARTITION BY doc_id ORDER BY start_at) AS prev FROM {source}),
{out}_g AS (SELECT o.doc_id, string_agg(substring(d.text, prev + 1, start_at - prev) || replacement, '' ORDER BY start_at) AS head, max(end_at) AS last, count(*)::INTEGER AS n
  FROM {out}_o o JOIN {docs} d ON d.doc_id = o.doc_id GROUP BY o.doc_id),
{out} AS (SELECT d.doc_id, CASE WHEN n IS NULL THEN d.text ELSE head || substring(d.text, last + 1) END AS redacted, coalesce(n, 0)::INTEGER AS n_spans FROM {docs} d LEFT JOIN {out}_g g ON g.doc_id = d.doc_id)"""


def resolved_contacts(spark: SparkSession, sf_dir: str, annotations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and their resolved, selected spans with replacements."""
    docs, rules = load(spark, sf_dir, "contacts"), load(spark, sf_dir, "rules")
    found = spans.resolve_conflicts(detect.detect_all(docs, rules, annotations))
    return docs, redact.resolve_replacement(found.where(spans.default_selection(F.col("score"))), load(spark, sf_dir, "policies"))


REPLACED = f"rep AS (SELECT r.*, coalesce(p.replacement, {DEFAULT_SQL.replace('entity_type', 'r.entity_type')}) AS replacement FROM res r LEFT JOIN policies p ON p.entity_type = r.entity_type WHERE r.score >= 0.3)"


def full_sql(docs: str) -> str:
    return f"WITH RECURSIVE {detected_sql(docs)}, ident AS ({IDENTIFIED}), {resolved_sql('ident')}, {REPLACED}, {redacted_sql(docs, 'rep')}"


SPAN_OUT = "doc_id, entity_type, value, start_at, end_at, score, source, detector_order"

for _name in ("PHONE", "EMAIL", "ID_CARD"):
    query(
        f"detect_{_name.lower()}", f"WITH {detected_sql('contacts', 'built-in')} SELECT {SPAN_OUT} FROM det WHERE entity_type = '{_name}'", "contacts",
    )(lambda spark, sf_dir, n=_name: detect.detect_pattern(load(spark, sf_dir, "contacts"), n))
for _kind in ("literal", "regex", "dictionary"):
    query(
        f"detect_{_kind}",
        f"WITH {detected_sql('texts', 'rule').replace('WHERE enabled', f"WHERE enabled AND kind = '{_kind}'")} SELECT {SPAN_OUT} FROM det", "texts", "rules",
    )(lambda spark, sf_dir, k=_kind: detect.detect_rules(spread(load(spark, sf_dir, "texts")), load(spark, sf_dir, "rules"), k))


@query("detect_all", f"WITH {detected_sql('texts')} SELECT {SPAN_OUT} FROM det", "texts", "rules")
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_all(spread(load(spark, sf_dir, "texts")), load(spark, sf_dir, "rules"))


@query("detect_terms", f"""WITH rules AS (SELECT 1 AS rule_id, 'NAME' AS entity_type, 'dictionary' AS kind, term AS pattern, true AS enabled
  FROM (SELECT DISTINCT c_name AS term FROM customer UNION SELECT '电话1')), {detected_sql('contacts', 'rule')}
SELECT doc_id, entity_type, value, start_at, end_at FROM det""", "contacts")
def detect_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = load(spark, sf_dir, "customer").select(F.lit("NAME").alias("entity_type"), F.col("c_name").alias("term"))
    terms = terms.unionByName(spark.sql("SELECT 'NAME' AS entity_type, '电话1' AS term"))
    return detect.detect_terms(load(spark, sf_dir, "contacts"), terms).select("doc_id", "entity_type", "value", "start_at", "end_at")


@query("external_annotations", """SELECT doc_id, CASE WHEN bool_and(score >= 0.5) FILTER (source = 'model') THEN 'annotated' ELSE 'failed' END AS status,
  CASE WHEN bool_and(score >= 0.5) FILTER (source = 'model') THEN NULL ELSE 'MODELS_NOT_READY' END AS error FROM (SELECT o.doc_id, source, score FROM span_texts o LEFT JOIN spans s ON s.doc_id = o.doc_id) GROUP BY doc_id""", "spans", "span_texts")
def external_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = load(spark, sf_dir, "spans").where("source = 'model'").select("doc_id", (F.col("score") >= 0.5).alias("ok"))
    judged = detect.judged_annotations(load(spark, sf_dir, "span_texts"), dealt(model, load(spark, sf_dir, "lineitem"), "doc_id"))
    return judged.select("doc_id", F.when(F.col("error").isNull(), "annotated").otherwise("failed").alias("status"), "error")


@query("chunk_text", """SELECT doc_id, c::INTEGER AS chunk, (c * 400)::INTEGER AS base_at, substring(text, c * 400 + 1, 450) AS text
FROM (SELECT doc_id, text, unnest(range(0, ((length(text) - 1) // 400) + 1)) AS c FROM texts WHERE length(text) > 0)""", "texts")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.chunk_text(spread(load(spark, sf_dir, "texts")))


@query("merge_chunk_spans", """SELECT doc_id, entity_type, start_at, end_at, arg_min(score, (chunk, -score)) AS score, min(chunk) AS chunk FROM (
  SELECT doc_id, entity_type, start_at, end_at, score / (1 + chunk) AS score, chunk FROM (SELECT *, unnest([0, 1, 2]) AS chunk FROM spans) WHERE chunk > 0 OR start_at % 3 <> 0) GROUP BY ALL""", "spans")
def merge_chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spans seen from three overlapping chunks, with falling scores, some not by
    the first, come out once, as the earliest saw them."""
    s = load(spark, sf_dir, "spans").withColumn("chunk", F.explode(F.array(F.lit(2), F.lit(0), F.lit(1)))).withColumn("base_at", F.col("chunk") * 20)
    s = s.where("chunk > 0 or start_at % 3 <> 0").withColumn("score", F.col("score") / (F.col("chunk") + 1))
    local = s.withColumn("start_at", F.col("start_at") - F.col("base_at")).withColumn("end_at", F.col("end_at") - F.col("base_at"))
    return detect.merge_chunk_spans(local)


@query("valid_entities", "SELECT entity_id, doc_id FROM spans WHERE score BETWEEN 0 AND 1 AND NOT isnan(score) AND start_at < end_at", "spans")
def valid_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.valid_entities(load(spark, sf_dir, "spans")).select("entity_id", "doc_id")


@query("validate_spans", "SELECT s.doc_id, bool_and(start_at >= 0 AND start_at < end_at AND end_at <= length(text)) AS valid FROM spans s JOIN span_texts t ON t.doc_id = s.doc_id GROUP BY s.doc_id", "spans", "span_texts")
def validate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.validate_spans(load(spark, sf_dir, "spans"), load(spark, sf_dir, "span_texts"))


@query("default_selection", "SELECT entity_id, score >= 0.3 AS selected FROM spans", "spans")
def default_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "spans").select("entity_id", spans.default_selection(F.col("score")).alias("selected"))


@query("entity_cap", "SELECT doc_id, count(*) AS n, CASE WHEN count(*) > 5 THEN 'TOO_MANY_ENTITIES' END AS error FROM spans GROUP BY doc_id", "spans")
def entity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.entity_cap(load(spark, sf_dir, "spans"), 5)


@query("entity_counts", "SELECT doc_id, entity_type, count(*) AS n FROM spans WHERE score >= 0.3 GROUP BY ALL", "spans")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "spans").where(spans.default_selection(F.col("score")))
    return s.groupBy("doc_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("resolve_conflicts", f"WITH RECURSIVE {resolved_sql('spans', '(end_at - start_at)')} SELECT doc_id, entity_id, start_at, end_at FROM res ", "spans")
def resolve_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "spans")
    return spans.resolve_conflicts(s, F.col("end_at") - F.col("start_at")).select("doc_id", "entity_id", "start_at", "end_at")


@query("offset_units", f"""WITH {detected_sql('contacts', 'built-in')} SELECT doc_id, entity_type, start_at, strlen(h)::INTEGER AS start_byte,
  (length(h) + length(regexp_replace(h, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))::INTEGER AS start_utf16
FROM (SELECT det.*, left(text, start_at) AS h FROM det JOIN contacts c ON c.doc_id = det.doc_id)""", "contacts")
def offset_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "contacts")
    return spans.located(detect.detect_all(docs), docs).select("doc_id", "entity_type", "start_at", "start_byte", "start_utf16")


_VIEW = f"""WITH {detected_sql('contacts', 'built-in')}, view AS (SELECT det.doc_id, entity_type, {LABEL_SQL} AS label, value,
  (start_at + length(regexp_replace(left(text, start_at), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))::INTEGER AS display_start,
  (end_at + length(regexp_replace(left(text, end_at), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))::INTEGER AS display_end
FROM det JOIN contacts c ON c.doc_id = det.doc_id) SELECT * FROM view"""


@query("entity_view", _VIEW, "contacts")
def entity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "contacts")
    return spans.entity_view(detect.detect_all(docs), docs)


@query("entity_search", _VIEW + " WHERE contains(value || label, '7@') OR contains(value || label, '7邮')", "contacts")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = entity_view(spark, sf_dir)
    return spans.entity_search(view, "7@").unionByName(spans.entity_search(view, "7邮")).distinct()


@query("default_replacement", f"SELECT entity_id, {DEFAULT_SQL} AS replacement FROM (SELECT s.*, substring(t.text, start_at + 1, end_at - start_at) AS value FROM spans s JOIN span_texts t ON t.doc_id = s.doc_id)", "spans", "span_texts")
def default_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "spans").join(load(spark, sf_dir, "span_texts"), "doc_id")
    value = F.substring("text", F.col("start_at") + 1, F.col("end_at") - F.col("start_at"))
    return s.select("entity_id", default_replacement(F.col("entity_type"), value).alias("replacement"))


@query("resolve_replacement", f"""SELECT entity_id, coalesce(own, p.replacement, {DEFAULT_SQL.replace('entity_type', 'v.entity_type')}) AS replacement
FROM (SELECT s.*, substring(t.text, start_at + 1, end_at - start_at) AS value, CASE WHEN start_at % 4 = 0 THEN 'own' END AS own FROM spans s JOIN span_texts t ON t.doc_id = s.doc_id) v
LEFT JOIN policies p ON p.entity_type = v.entity_type""", "spans", "span_texts", "policies")
def resolve_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "spans").join(load(spark, sf_dir, "span_texts"), "doc_id")
    s = s.withColumn("value", F.substring("text", F.col("start_at") + 1, F.col("end_at") - F.col("start_at"))).withColumn("replacement", F.when(F.col("start_at") % 4 == 0, "own"))
    return redact.resolve_replacement(s, load(spark, sf_dir, "policies")).select("entity_id", "replacement")


@query("redact_documents", full_sql("texts") + f""" SELECT red.doc_id, CASE WHEN strlen(text) BETWEEN 1 AND {onepass.MOST_TEXT_BYTES} THEN redacted END AS redacted, CASE WHEN strlen(text) BETWEEN 1 AND {onepass.MOST_TEXT_BYTES} THEN n_spans ELSE 0 END AS n_spans,
  CASE WHEN coalesce(strlen(text), 0) = 0 THEN 'EMPTY_TEXT' WHEN strlen(text) > {onepass.MOST_TEXT_BYTES} THEN 'TEXT_TOO_LARGE' END AS error FROM red JOIN texts ON texts.doc_id = red.doc_id""", "texts", "rules", "policies")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.redact_texts(spread(load(spark, sf_dir, "texts")), load(spark, sf_dir, "rules"), load(spark, sf_dir, "policies"))


#: An annotation of some contacts, which is too unsure of some.
NAMED = "SELECT doc_id, 'PERSON' AS entity_type, substring(text, 3, 18) AS value, 2 AS start_at, 20 AS end_at, CASE WHEN doc_id % 3 = 0 THEN 0.1 ELSE 0.9 END::DOUBLE AS score, 'model' AS source, 0 AS detector_order FROM contacts WHERE doc_id % 2 = 0"
_MOST = 4


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("doc_id") % 3 == 0, 0.1).otherwise(0.9)
    return load(spark, sf_dir, "contacts").where("doc_id % 2 = 0").select("doc_id", F.lit("PERSON").alias("entity_type"), F.substring("text", 3, 18).alias("value"), F.lit(2).alias("start_at"), F.lit(20).alias("end_at"), score.alias("score"), F.lit("model").alias("source"))


@query("redact_contacts", f"""WITH RECURSIVE {detected_sql('contacts', out='found')}, det AS (SELECT {SPAN_OUT} FROM found UNION ALL {NAMED}), ident AS ({IDENTIFIED}), {resolved_sql('ident')}, {REPLACED}, {redacted_sql('contacts', 'rep')}
SELECT doc_id, redacted, n_spans FROM red""", "contacts", "rules", "policies")
def redact_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From spans in a table: detection, annotations, conflicts, selection, replacements and
    texts joined by id."""
    docs, found = resolved_contacts(spark, sf_dir, named(spark, sf_dir))
    return redact.redact_documents(docs, found).select("doc_id", "redacted", "n_spans")


@query("redact_fail_closed", f"""WITH RECURSIVE {detected_sql('contacts', out='found')}, det AS (SELECT {SPAN_OUT} FROM found UNION ALL {NAMED}), ident AS ({IDENTIFIED}), {resolved_sql('ident')}, {REPLACED}, {redacted_sql('contacts', 'rep')},
n AS (SELECT doc_id, count(*) AS n FROM det GROUP BY 1),
o AS (SELECT red.*, CASE WHEN red.doc_id % 7 IN (3, 5) THEN 'MODELS_NOT_READY' WHEN n > {_MOST} THEN 'TOO_MANY_ENTITIES' END AS error FROM red JOIN n ON n.doc_id = red.doc_id)
SELECT doc_id, CASE WHEN error IS NULL THEN redacted END AS redacted, CASE WHEN error IS NULL THEN n_spans ELSE 0 END AS n_spans, error FROM o""", "contacts", "rules", "policies")
def redact_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated contacts: the annotation of some is missing, of some it failed, and with it
    some have more spans than are allowed. None of these has a redacted text."""
    docs = load(spark, sf_dir, "contacts")
    status = docs.where("doc_id % 7 <> 5").select("doc_id", (F.col("doc_id") % 7 != 3).alias("ok"))
    return redact.redact_texts(docs, load(spark, sf_dir, "rules"), load(spark, sf_dir, "policies"), _MOST, status, named(spark, sf_dir))


@query("redact_overlap_error", """WITH o AS (SELECT doc_id, bool_or(start_at < prev) AS bad, count(*)::INTEGER AS n FROM (SELECT *, lag(end_at) OVER (PARTITION BY doc_id ORDER BY start_at, end_at) AS prev FROM spans) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n, 0)::INTEGER AS n_spans, CASE WHEN bad THEN 'OVERLAP' END AS error FROM span_texts t LEFT JOIN o ON o.doc_id = t.doc_id""", "spans", "span_texts")
def redact_overlap_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "spans").withColumn("replacement", F.lit("x"))
    return redact.redact_documents(load(spark, sf_dir, "span_texts"), s).select("doc_id", "n_spans", "error")


@query("redact_segments", full_sql("contacts") + """, seg AS (
  SELECT doc_id, NULL AS entity_type, prev AS a, start_at AS b FROM red_o UNION ALL SELECT doc_id, entity_type, start_at, end_at FROM red_o
  UNION ALL SELECT d.doc_id, NULL, coalesce(last, 0), length(text) FROM contacts d LEFT JOIN red_g g ON g.doc_id = d.doc_id)
SELECT seg.doc_id, a::INTEGER AS seg_start, b::INTEGER AS seg_end, entity_type, substring(text, a + 1, b - a) AS text FROM seg JOIN contacts c ON c.doc_id = seg.doc_id WHERE a < b""", "contacts", "rules", "policies")
def redact_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = resolved_contacts(spark, sf_dir)
    return redact.redact_segments(docs, found)


@query("fragment_offsets", """SELECT doc_id, frag_no, (sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY frag_no) - 1 - length(text))::INTEGER AS start_at,
  (sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY frag_no) - 1)::INTEGER AS end_at FROM fragments""", "fragments")
def fragment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.fragment_offsets(load(spark, sf_dir, "fragments"), "\n").select("doc_id", "frag_no", "start_at", "end_at")


_PIECES = """pieces AS (SELECT doc_id, frag_no, text, (frag_no * 13)::INTEGER AS p_start, (frag_no * 13 + length(text))::INTEGER AS p_end FROM slices)"""


@query("piece_overlap", f"WITH {detected_sql('contacts', 'built-in')}, {_PIECES} SELECT det.doc_id, entity_type, start_at, frag_no FROM det JOIN pieces p ON p.doc_id = det.doc_id AND start_at < p_end AND p_start < end_at", "contacts", "slices")
def piece_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect_all(load(spark, sf_dir, "contacts"))
    return redact.piece_overlap(found, redact.fragment_offsets(load(spark, sf_dir, "slices"))).select("doc_id", "entity_type", "start_at", "frag_no")


@query("redact_fragments", full_sql("contacts") + f""", {_PIECES}, hit AS (
  SELECT p.doc_id, frag_no, greatest(start_at, p_start) - p_start AS start_at, least(end_at, p_end) - p_start AS end_at, CASE WHEN start_at >= p_start THEN replacement ELSE '' END AS replacement
  FROM rep JOIN pieces p ON p.doc_id = rep.doc_id AND start_at < p_end AND p_start < end_at),
keyed AS (SELECT doc_id * 1000 + frag_no AS doc_id, start_at, end_at, replacement FROM hit), frag AS (SELECT doc_id * 1000 + frag_no AS doc_id, doc_id AS d, frag_no, text FROM slices),
{redacted_sql('frag', 'keyed', 'fr')} SELECT d AS doc_id, frag_no, redacted FROM fr JOIN frag ON frag.doc_id = fr.doc_id""", "contacts", "rules", "policies", "slices")
def redact_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = resolved_contacts(spark, sf_dir)
    return redact.redact_fragments(load(spark, sf_dir, "slices"), found)


_CELLS = """cells AS (SELECT c_custkey * 2 AS doc_id, c_custkey AS row_id, 'note' AS col, text FROM customer JOIN contacts ON doc_id = c_custkey
  UNION ALL SELECT c_custkey * 2 + 1, c_custkey, 'mail', lower(c_mktsegment) || '@shop.example.org ' || c_name FROM customer)"""


@query("redact_columns", full_sql("cells").replace("WITH RECURSIVE ", f"WITH RECURSIVE {_CELLS}, ") + """
SELECT row_id, max(CASE WHEN col = 'note' THEN redacted END) AS note, max(CASE WHEN col = 'mail' THEN redacted END) AS mail FROM red JOIN cells ON cells.doc_id = red.doc_id GROUP BY row_id""", "contacts", "rules", "policies")
def redact_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two string columns of a table: unpivot, redact, pivot."""
    c = load(spark, sf_dir, "customer")
    mail = F.concat(F.lower("c_mktsegment"), F.lit("@shop.example.org "), "c_name")
    rows = c.select("c_custkey", mail.alias("mail")).join(load(spark, sf_dir, "contacts").withColumnsRenamed({"doc_id": "c_custkey", "text": "note"}), "c_custkey")
    cells = rows.unpivot(["c_custkey"], ["note", "mail"], "col", "text")
    cells = cells.select((F.col("c_custkey") * 2 + F.when(F.col("col") == "mail", 1).otherwise(0)).alias("doc_id"), "text")
    done = redact.redact_texts(cells, load(spark, sf_dir, "rules"), load(spark, sf_dir, "policies"))
    col = F.when(F.col("doc_id") % 2 == 0, "note").otherwise("mail")
    return done.select(F.expr("doc_id div 2").alias("row_id"), col.alias("col"), "redacted").groupBy("row_id").pivot("col", ["note", "mail"]).agg(F.first("redacted"))


@query("redaction_preview", full_sql("contacts") + " SELECT red.doc_id, text AS before, redacted AS after FROM red JOIN contacts c ON c.doc_id = red.doc_id JOIN tasks t ON t.task_id = red.doc_id WHERE t.state IN ('awaiting_review', 'completed')", "contacts", "rules", "policies", "tasks")
def redaction_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "contacts")
    ready = load(spark, sf_dir, "tasks").where("state in ('awaiting_review', 'completed')").select(F.col("task_id").alias("doc_id"))
    after = redact.redact_texts(docs.join(ready, "doc_id", "left_semi"), load(spark, sf_dir, "rules"), load(spark, sf_dir, "policies"))
    return after.join(docs, "doc_id").select("doc_id", F.col("text").alias("before"), F.col("redacted").alias("after"))


@query("type_labels", f"SELECT entity_id, {LABEL_SQL} AS label FROM spans", "spans")
def type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "spans").select("entity_id", type_label(F.col("entity_type")).alias("label"))


_BUILT = " UNION ALL ".join(f"SELECT '{t}' AS entity_type, '{b}' AS behavior, '{x}' AS value" for t, b, xs in BUILT_IN for x in xs)


@query("builtin_policies", f"SELECT b.entity_type, {LABEL_SQL.replace('entity_type', 'b.entity_type')} AS label, behavior, value AS original, {DEFAULT_SQL.replace('entity_type', 'b.entity_type')} AS replacement, coalesce(n, 0) AS uses FROM ({_BUILT}) b LEFT JOIN (SELECT entity_type, count(*) AS n FROM spans GROUP BY 1) s ON s.entity_type = b.entity_type", "spans")
def builtin_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with its examples, and how many spans each type has."""
    rows = spark.createDataFrame([(t, b, x) for t, b, xs in BUILT_IN for x in xs], "entity_type string, behavior string, original string")
    uses = load(spark, sf_dir, "spans").groupBy("entity_type").agg(F.count(F.lit(1)).alias("uses"))
    out = rows.join(uses, "entity_type", "left")
    return out.select("entity_type", type_label(F.col("entity_type")).alias("label"), "behavior", "original", default_replacement(F.col("entity_type"), F.col("original")).alias("replacement"), F.coalesce("uses", F.lit(0)).alias("uses"))


#: A careless replacement, which leaves some values of every type in sight.
_CARELESS = "CASE WHEN doc_id % 9 = 4 THEN '<' || value || '>' WHEN doc_id % 9 = 6 AND entity_type = 'EMAIL' THEN 'me@' || 'example.org' ELSE replacement END"
_LEFT = full_sql("contacts").replace(redacted_sql("contacts", "rep"), f"careless AS (SELECT doc_id, entity_type, value, start_at, end_at, {_CARELESS} AS replacement FROM rep), {redacted_sql('contacts', 'careless')}")


def _careless(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts redacted carelessly, and the spans that were to go."""
    docs, found = resolved_contacts(spark, sf_dir)
    found = found.withColumn("replacement", F.expr(_CARELESS))
    return redact.redact_documents(docs, found), found


@query("leak_audit", _LEFT + " SELECT DISTINCT rep.doc_id, entity_type, value FROM rep JOIN red ON red.doc_id = rep.doc_id WHERE contains(redacted, value)", "contacts", "rules", "policies")
def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.leak_audit(*_careless(spark, sf_dir))


@query("block_leaks", _LEFT + """, leak AS (SELECT DISTINCT rep.doc_id FROM rep JOIN red ON red.doc_id = rep.doc_id WHERE contains(redacted, value))
SELECT red.doc_id, CASE WHEN leak.doc_id IS NULL THEN redacted END AS redacted, CASE WHEN leak.doc_id IS NULL THEN n_spans ELSE 0 END AS n_spans, CASE WHEN leak.doc_id IS NOT NULL THEN 'LEAK' END AS error FROM red LEFT JOIN leak ON leak.doc_id = red.doc_id""", "contacts", "rules", "policies")
def block_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.block_leaks(*_careless(spark, sf_dir))


@query("residual_rescan", _LEFT + f""", again AS (SELECT doc_id, redacted AS text FROM red), {detected_sql('again', 'built-in', 'det2')}
SELECT entity_type, count(*) AS n FROM det2 GROUP BY entity_type""", "contacts", "rules", "policies")
def residual_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.residual_rescan(_careless(spark, sf_dir)[0])
