"""Very long values, repeated rows and extra columns with the names of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from desense.llm import ann, licence_scan, token_rollup, url_filter
from desense.llm.queries import URL_RULES

PAGE = "page_id long, url string"


def judged(spark, rows, listed=("http://a.bad.com/x",)):
    pages = spark.createDataFrame(rows, PAGE)
    clashing = pages.withColumns({c: F.lit("mine") for c in ("host", "path", "rule", "verdict", "listed", "canonical", "block", "w0", "_query", "_verdict")})
    known = spark.createDataFrame([(u, "x") for u in listed], "url string, canonical string")
    return sorted(map(tuple, url_filter.url_filter(clashing, known, URL_RULES).collect()), key=str)


def test_url_rows_that_repeat_and_clash(spark):
    rows = [(1, "http://a.bad.com/x"), (1, "http://a.bad.com/x"), (2, "http://A.bad.com/x/"), (3, None), (None, "http://s.net/"), (4, "http://good.com/")]
    assert judged(spark, rows) == sorted([
        (1, "a.bad.com", "/x", None, "block", True), (1, "a.bad.com", "/x", None, "block", True), (2, "a.bad.com", "/x/", None, "block", True), (3, "", "", None, "allow", False),
        (None, "s.net", "/", "net/", "block", False), (4, "good.com", "/", None, "allow", False),
    ], key=str)


def test_a_very_long_url(spark):
    long = "http://h.com/" + "a/" * 500_000
    assert [r[4:] for r in judged(spark, [(1, long), (2, long + "b")], [long])] == [("block", True), ("allow", False)]


def test_a_very_long_text_has_its_licence(spark):
    words = "word of text and more " * 400_000
    docs = spark.createDataFrame([(1, words + "Released under the MIT License. " + words), (2, words)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_words", "labels", "score")})
    got = {r.doc_id: (r.labels, r.n_base, r.n_words) for r in licence_scan.scan_licences(docs).collect()}
    assert got == {1: ("mit", 1, 4_000_005), 2: ("", 0, 2_000_000)}


def test_a_rollup_of_a_very_long_text(spark, tmp_path):
    docs = spark.createDataFrame([("word " * 2_000_000,)], "text string")
    counted = docs.select(F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit("v").alias("tokenizer_version"), F.regexp_count("text", F.lit(r"\w+")).alias("n_tokens"), F.lit(1).alias("sign"), F.lit(2).alias("attempt"))
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    rollup.commit(1, token_rollup.signed(counted, 1))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", None, "v", 1, 2_000_000)]


def test_neighbours_beside_columns_of_their_names(spark):
    rows = [(i, [float(i % 7), float(i), 1.0]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    clashing = table.withColumns({c: F.lit("mine") for c in ("query_id", "rank", "score", "key", "curve", "block", "id", "v")})
    want = sorted(map(tuple, ann.nearest(table, F.col("vec_id") % 10 == 0).select("query_id", "rank", "vec_id", "score").collect()))
    assert sorted(map(tuple, ann.nearest(clashing, F.col("vec_id") % 10 == 0).select("query_id", "rank", "vec_id", "score").collect())) == want and len(want) == 30
