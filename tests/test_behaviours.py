"""Behaviours on tiny tables: conflicts, redaction, boundaries, names, sequences, vault."""

from __future__ import annotations

import random
import re
import time

import pytest
from compare import SF_DIR
from pyspark.sql import functions as F

from desense.functions import geometry
from desense.operators import audit, detect, onepass, redact, review, sequence, spans, tasks, vault
from desense.sources import encodings, sinks
from desense.streaming import jobs

SPAN = "doc_id long, entity_id string, entity_type string, value string, start_at int, end_at int, score double, source string, detector_order int"


def span_rows(spark, rows):
    return spark.createDataFrame([(1, f"e{i:04}", "T", "x" * (e - s), s, e, sc, "r", 1) for i, (s, e, sc) in enumerate(rows)], SPAN)


def test_conflicts_keep_the_best(spark):
    kept = spans.resolve_conflicts(span_rows(spark, [(1, 8, 0.9), (0, 4, 1.0), (4, 9, 0.9), (10, 12, 0.8), (9, 13, 0.8)]))
    assert sorted((r.start_at, r.end_at) for r in kept.collect()) == [(0, 4), (4, 9), (9, 13)]


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_conflicts_invariants(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rnd = random.Random(5)
    rows = [(s := rnd.randrange(60), s + 1 + rnd.randrange(8), round(rnd.random(), 2)) for _ in range(80)]
    kept = sorted((r.start_at, r.end_at, -r.score) for r in spans.resolve_conflicts(span_rows(spark, rows)).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:], strict=False))
    chosen = {(s, e, -sc) for s, e, sc in kept}
    for s, e, sc in set(rows) - chosen:
        assert any(a < e and s < b and (c, b - a) >= (sc, e - s) for a, b, c in chosen)


def test_bytes_count_for_priority(spark):
    rows = [(1, "a", "T", "汉字汉", 0, 3, 0.5, "r", 1), (1, "b", "T", "abcde", 2, 7, 0.5, "r", 1)]
    assert [r.entity_id for r in spans.resolve_conflicts(spark.createDataFrame(rows, SPAN)).collect()] == ["a"]


def test_invalid_scores_go(spark):
    rows = [(0, 2, float("nan")), (3, 4, 1.5), (5, 6, -0.1), (7, 7, 0.5), (8, 9, 0.5)]
    assert [r.start_at for r in spans.resolve_conflicts(span_rows(spark, rows)).collect()] == [8]


def test_phone_needs_free_sides(spark):
    docs = spark.createDataFrame([(1, "电话13812345678，编号 1381234567890")], "doc_id long, text string")
    assert [(r.value, r.start_at) for r in detect.detect_pattern(docs, "PHONE").collect()] == [("13812345678", 2)]


def test_nothing_to_redact_is_identity(spark):
    docs = spark.createDataFrame([(1, "a😀b"), (2, "")], "doc_id long, text string")
    none = span_rows(spark, []).withColumn("replacement", F.lit("x"))
    assert {r.doc_id: r.redacted for r in redact.redact_documents(docs, none).collect()} == {1: "a😀b", 2: ""}


def test_span_over_fragments(spark):
    parts = spark.createDataFrame([(1, 0, "ab张"), (1, 1, "三&c")], "doc_id long, frag_no int, text string")
    edit = spark.createDataFrame([(1, 2, 4, "某人")], "doc_id long, start_at int, end_at int, replacement string")
    assert {r.frag_no: r.redacted for r in redact.redact_fragments(parts, edit).collect()} == {0: "ab某人", 1: "&c"}


def test_offsets_of_an_emoji(spark):
    b, u = spans.offset_units(F.col("t"), F.lit(2))
    assert tuple(spark.createDataFrame([("😀汉x",)], "t string").select(b, u).first()) == (7, 3)


def test_refused_rules(spark):
    rows = [(1, "n", "T", "regex", "(?<=a)b"), (2, "n", "T", "regex", r"(a)\1"), (3, "n", "T", "regex", "a*"), (4, "n", "T", "literal", "a*"), (5, "n", "T", "regex", r"\\1")]
    found = detect.validate_rules(spark.createDataFrame(rows, "rule_id long, name string, entity_type string, kind string, pattern string"))
    assert {r.rule_id: r.error for r in found.collect()} == {1: "REFUSED_CONSTRUCT", 2: "REFUSED_CONSTRUCT", 3: "MATCHES_EMPTY", 4: None, 5: None}


def test_terms_do_not_overlap_themselves(spark):
    docs = spark.createDataFrame([(1, "aaa aaaa")], "doc_id long, text string")
    terms = spark.createDataFrame([("T", "aa")], "entity_type string, term string")
    assert sorted(r.start_at for r in detect.detect_terms(docs, terms).collect()) == [0, 4, 6]


def test_tag_path(spark):
    rows = [(1, 0, [2.0, 1.0]), (1, 1, [2.0, 1.0]), (2, 0, [float("nan"), 1.0])]
    e = spark.createDataFrame(rows, "seq_id long, pos int, values array<double>")
    got = sequence.decode_tag_path(e, [0.0, 3.0], [0.0, 0.0], [[0.0, -10.0], [-10.0, 0.0]])
    assert sorted((r.seq_id, r.pos, r.tag) for r in got.collect() if r.pos is not None) == [(1, 0, 1), (1, 1, 1)]
    assert [r.seq_id for r in got.collect() if r.pos is None] == [2]


def test_o_does_not_close(spark):
    rows = [(1, i, t, 0.5, i, i + 1) for i, t in enumerate(["B-PER", "O", "I-PER", "E-LOC", "I-ORG"])]
    got = sequence.assemble_tag_spans(spark.createDataFrame(rows, "seq_id long, pos int, label string, score double, start_at int, end_at int"))
    assert sorted((r.entity_type, r.start_at, r.end_at) for r in got.collect()) == [("ORGANIZATION", 4, 5), ("PERSON", 0, 4)]


def test_names(spark):
    df = spark.createDataFrame([("/x/con.txt",), ("C:\\a<b.md ",), ("/x/",)], "path string")
    assert [r[0] for r in df.select(tasks.safe_name(F.col("path"))).collect()] == ["_con.txt", "a_b.md", "未命名文件"]


@pytest.mark.parametrize("code", list(encodings.MARKS))
def test_encodings_round_trip(spark, code):
    docs = spark.createDataFrame([(1, "甲乙\r\n丙", code)], "doc_id long, text string, encoding string")
    raw, _ = encodings.encode_corpus(docs)
    good, bad = encodings.decode_corpus(raw)
    assert [(r.text, r.encoding) for r in good.collect()] == [("甲乙\r\n丙", code)] and not bad.count()


def test_a_real_replacement_character_is_no_error(spark):
    raw = spark.createDataFrame([(1, "a\ufffdb".encode()), (2, b"a\xff\xfe\x80")], "doc_id long, content binary")
    good, bad = encodings.decode_corpus(raw)
    assert [(r.doc_id, r.text) for r in good.collect()] == [(1, "a\ufffdb")] and [r.doc_id for r in bad.collect()] == [2]


def test_long_tag_labels_stay_whole(spark):
    rows = [(1, 0, "B-" + "X" * 150, 0.5, 0, 1)]
    got = sequence.assemble_tag_spans(spark.createDataFrame(rows, "seq_id long, pos int, label string, score double, start_at int, end_at int"))
    assert got.first().entity_type == "X" * 150


REVIEWS = "doc_id long, state string, revision int, reviewed_revision int, page_count int, output_valid boolean"


def test_edits_need_the_right_revision_and_drop_the_output(spark):
    reviews = spark.createDataFrame([(1, "awaiting_review", 3, 3, 1, True), (2, "awaiting_review", 4, 4, 1, True), (3, "completed", 3, 3, 1, True)], REVIEWS)
    box = [(0.1, 0.1), (0.4, 0.1), (0.4, 0.3)]
    kind = "polygon array<struct<x:double,y:double>>"
    regions = spark.createDataFrame([(1, 7, 0, "ocr", "old", box), (1, 8, 0, "manual", "m", box)], f"doc_id long, region_id int, page int, source string, text string, {kind}")
    edits = spark.createDataFrame([(1, 7, 0, "new", box, 3), (1, 9, 1, "page", box, 3), (2, 7, 0, "late", box, 3), (3, 7, 0, "done", box, 3), (4, 7, 0, "none", box, 3)], f"doc_id long, region_id int, page int, text string, {kind}, expected int")
    after, saved, errors = review.upsert_regions(regions, edits, reviews)
    assert sorted((r.doc_id, r.region_id, r.source, r.text) for r in after.collect()) == [(1, 7, "manual", "new"), (1, 8, "manual", "m")]
    assert sorted((r.doc_id, r.revision, r.reviewed_revision, r.output_valid) for r in saved.collect()) == [(1, 4, 4, False), (2, 4, 4, True), (3, 3, 3, True)]
    assert sorted((r.doc_id, r.error) for r in errors.collect()) == [(1, "INVALID_REGION"), (2, "REVISION_CONFLICT"), (3, "INVALID_TASK_STATE"), (4, "TASK_MISSING")]
    left, saved, errors = review.remove_regions(regions, edits.select("doc_id", F.lit(8).alias("region_id"), "expected").distinct(), reviews)
    assert [r.region_id for r in left.collect()] == [7] and saved.where("doc_id = 1").first().revision == 4
    assert sorted((r.doc_id, r.error) for r in errors.collect()) == [(2, "REVISION_CONFLICT"), (3, "INVALID_TASK_STATE"), (4, "TASK_MISSING")]


def test_gbk_has_no_emoji(spark):
    docs = spark.createDataFrame([(1, "😀", "gbk")], "doc_id long, text string, encoding string")
    assert encodings.encode_corpus(docs)[1].first()["error"] == "UNENCODABLE"


def test_vault_fails_closed(spark):
    values = spark.createDataFrame([(1, "a", b"secret"), (2, "a", b"")], "id long, part string, content binary")
    key = b"k" * 16
    sealed = vault.vault_seal(values, key)
    assert {r.id: bytes(r.content) for r in vault.vault_open(sealed, key)[0].collect()} == {1: b"secret", 2: b""}
    assert vault.vault_open(sealed, b"x" * 16)[0].count() == 0
    assert vault.vault_open(sealed.withColumn("part", F.lit("b")), key)[0].count() == 0
    chunks = vault.vault_chunks(values, key, 2)
    assert {r.id: bytes(r.content) for r in vault.vault_restore(chunks, key)[0].collect()} == {1: b"secret", 2: b""}
    assert [r.id for r in vault.vault_restore(chunks.where("n <> 1"), key)[1].collect()] == [1]


def test_never_over_an_existing_result(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None)], "doc_id long, redacted string, error string")
    sinks.write_redacted(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_redacted(df, str(tmp_path / "out"))


def test_row_redaction_equals_batch(spark):
    docs = spark.createDataFrame([(1, "电话13812345678 a@b.cc"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: (r.redacted, r.error) for r in jobs.stream_redact(docs).collect()}
    assert got == {1: ("电话138****5678 ***@***", None), 2: (None, "EMPTY_TEXT"), 3: (None, "EMPTY_TEXT")}


def rule_rows(spark, *rows):
    return spark.createDataFrame([(i + 1, "n", "T", k, p, True) for i, (k, p) in enumerate(rows)], "rule_id long, name string, entity_type string, kind string, pattern string, enabled boolean")


def policy_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "policy_id long, entity_type string, replacement string")


def test_dictionary_terms_are_lines(spark):
    docs = spark.createDataFrame([(1, "x A|B y"), (2, "A B license"), (3, "spam eggs")], "doc_id long, text string")
    rules = rule_rows(spark, ("dictionary", "A|B\r\nlicense\nlicense\r\n\r\n spam \t\r\n"))
    found = detect.detect_rules(docs, rules).collect()
    assert sorted((r.doc_id, r.value, r.start_at) for r in found) == [(1, "A|B", 2), (2, "license", 4), (3, "spam", 0)]
    assert detect.validate_rules(rules).first().error is None
    out = redact.redact_texts(docs, rules, policy_rows(spark, (1, "T", "#"))).collect()
    assert {r.doc_id: (r.redacted, r.n_spans, r.error) for r in out} == {1: ("x # y", 1, None), 2: ("A B #", 1, None), 3: ("# eggs", 1, None)}


def test_a_span_that_comes_twice_is_one(spark):
    twice = span_rows(spark, [(0, 3, 1.0)]).unionByName(span_rows(spark, [(0, 3, 1.0)]))
    assert spans.resolve_conflicts(twice).count() == 1


def test_first_policy_of_a_type_counts(spark):
    found = span_rows(spark, [(0, 3, 1.0)])
    for rows in ([(1, "T", "z"), (2, "T", "a")], [(2, "T", "a"), (1, "T", "z")]):
        assert redact.resolve_replacement(found, policy_rows(spark, *rows).repartition(3)).first().replacement == "z"


def test_what_must_not_come_out(spark):
    texts = [(1, "a@b.cc x"), (2, "a@b.cc x"), (3, "a@b.cc x"), (4, "x " * 9), (5, None), (6, ""), (7, "x" * (8 * 1024 * 1024 + 1)), (8, "a@b.cc x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    status = spark.createDataFrame([(i, i != 2) for i in range(1, 8) if i != 3] + [(8, True)], "doc_id long, ok boolean")
    named = spark.createDataFrame([(1, "PERSON", 7, 8, 0.9, "model"), (8, "PERSON", 7, 99, 0.9, "model")], "doc_id long, entity_type string, start_at int, end_at int, score double, source string")
    out = redact.redact_texts(docs, rule_rows(spark, ("literal", "x")), policy_rows(spark, (1, "PERSON", "P"), (2, "T", "-")), 8, status, named).collect()
    assert {r.doc_id: (r.redacted, r.error) for r in out} == {
        1: ("***@*** -", None), 2: (None, "MODELS_NOT_READY"), 3: (None, "MODELS_NOT_READY"), 4: (None, "TOO_MANY_ENTITIES"),
        5: (None, "EMPTY_TEXT"), 6: (None, "EMPTY_TEXT"), 7: (None, "TEXT_TOO_LARGE"), 8: (None, "SPAN_OUTSIDE"),
    }


def test_many_matches_take_linear_time(spark):
    began = time.time()
    docs = spark.createDataFrame([(1, "aa@bb.cc " * 100_000)], "doc_id long, text string")
    assert redact.redact_texts(docs, None, policy_rows(spark, (1, "T", ""))).first().redacted == "***@*** " * 100_000
    assert jobs.stream_redact(docs).first().redacted == "***@*** " * 100_000
    assert time.time() - began < 60


def test_one_scan_of_the_texts_and_no_nested_loop(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plan = redact.redact_texts(docs, rule_rows(spark, ("regex", "[0-9]{16}"), ("dictionary", "a\nb")), policy_rows(spark, (1, "T", "")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "NestedLoop" not in plan


def test_a_hundred_thousand_terms(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    words = docs.select(F.explode(F.split("text", " ")).alias("term")).where("length(term) > 5").distinct()
    terms = words.unionByName(spark.range(100_000).select(F.concat(F.lit("term number "), "id").alias("term"))).withColumn("entity_type", F.lit("T"))
    assert detect.detect_terms(docs, terms).count() > 1000


def test_rules_that_do_not_compile(spark):
    rules = rule_rows(spark, ("regex", "("), ("regex", "a{2,1}"), ("regex", "a|"), ("regex", "[a-z]+"), ("dictionary", "\r\n \n"), ("literal", ""))
    assert {r.rule_id: r.error for r in detect.validate_rules(rules).collect()} == {1: "DOES_NOT_COMPILE", 2: "DOES_NOT_COMPILE", 3: "MATCHES_EMPTY", 4: None, 5: "TERMS", 6: "BLANK"}


def test_overlaps_across_buckets_count_once(spark, monkeypatch):
    monkeypatch.setattr(redact, "OFFSET_BUCKET", 4)
    found = spark.createDataFrame([(1, 2, 15), (1, 20, 21)], "doc_id long, start_at int, end_at int")
    parts = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 12), (1, 2, 12, 40)], "doc_id long, frag_no int, start_at int, end_at int")
    assert sorted((r.start_at, r.frag_no) for r in redact.piece_overlap(found, parts).collect()) == [(2, 0), (2, 1), (2, 2), (20, 2)]


def test_unsure_spans_stay_in_the_text(spark):
    docs = spark.createDataFrame([(1, "anna met bob"), (2, "anna met bob")], "doc_id long, text string")
    status = spark.createDataFrame([(1, True), (2, True), (2, False)], "doc_id long, ok boolean")
    named = spark.createDataFrame([(i, "PERSON", a, b, s, "model") for i in (1, 2) for a, b, s in ((0, 4, 0.1), (9, 12, 0.9), (8, 10, 0.29))], "doc_id long, entity_type string, start_at int, end_at int, score double, source string")
    policies = policy_rows(spark, (1, "PERSON", "[X]"))
    out = {r.doc_id: (r.redacted, r.n_spans, r.error) for r in redact.redact_texts(docs, None, policies, status=status, annotations=named).collect()}
    assert out == {1: ("anna met [X]", 1, None), 2: (None, 0, "MODELS_NOT_READY")}


@pytest.mark.parametrize("make", [lambda n: "a" * n + " @", lambda n: "a" * n + "@", lambda n: "a@" + "b" * n, lambda n: "a@b." * (n // 4)], ids=["run", "run and at", "domain", "many"])
def test_mail_search_is_linear(spark, make):
    took = []
    for n in (40_000, 4_000_000):
        docs = spark.createDataFrame([(1, make(n))], "doc_id long, text string").repartition(1)
        began = time.time()
        assert redact.redact_texts(docs, None, policy_rows(spark, (1, "T", ""))).where("error is null").count() == 1
        took.append(time.time() - began)
    assert took[1] < 20


def test_mail_matches_are_those_of_the_pattern(spark):
    rnd = random.Random(1)
    texts = [(i, "".join(rnd.choice("ab1._%+-@@..Z9 中\n﷐") for _ in range(rnd.randrange(1, 60)))) for i in range(4000)]
    found = detect.detect_pattern(spark.createDataFrame(texts, "doc_id long, text string"), "EMAIL").collect()
    want = [(i, m.start(), m.group()) for i, t in texts for m in re.finditer(detect.PATTERNS[1][1], t)]
    assert sorted((r.doc_id, r.start_at, r.value) for r in found) == want and len(want) > 20


def test_untouched_texts_stay_in_the_engine(spark):
    """Python gets the text only where something was found, and no other column of the row."""
    docs = spark.createDataFrame([(1, "a@b.cc", "z" * 9)], "doc_id long, text string, other string")
    plan = onepass.kept_spans(docs, detect.BUILT_INS, [])._jdf.queryExecution().optimizedPlan().toString()
    call = re.search(r"found\(.*?\)#", plan)[0]
    assert "CASE WHEN _touched" in call and "other" not in call


def test_saving_decisions_scans_each_input_once(spark, tmp_path):
    s = span_rows(spark, [(0, 3, 0.9), (4, 6, 0.1)]).withColumn("selected", F.lit(True)).withColumn("replacement", F.lit("old"))
    s.write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([(1, "e0000", False, None), (1, "e0001", True, "new"), (2, "e0000", True, None)], "doc_id long, entity_id string, selected boolean, replacement string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(1, "awaiting_review", 3, 3, 1, True), (2, "awaiting_review", 1, 1, 1, True)], REVIEWS).write.parquet(str(tmp_path / "r"))
    tables = [spark.read.parquet(str(tmp_path / n)) for n in "sdr"]
    after, reviews, errors = review.save_decisions(*tables)
    assert sorted((r.entity_id, r.selected, r.replacement) for r in after.collect()) == [("e0000", False, None), ("e0001", True, "new")]
    assert sorted((r.doc_id, r.revision, r.output_valid) for r in reviews.collect()) == [(1, 4, False), (2, 1, True)]
    assert [(r.doc_id, r.error) for r in errors.collect()] == [(2, "FOREIGN")]
    for out, scans in ((after, 3), (reviews, 3), (errors, 3), (review.apply_decisions(*tables[:2]), 2)):
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("FileScan") <= scans and plan.count("Exchange ") <= 2 and "Join" not in plan


def test_regions_take_what_was_decided_and_keep_their_own(spark):
    regions = spark.createDataFrame([(1, 1, "a", False, None), (1, 2, None, True, "mine"), (1, 3, "b", True, "own")], "doc_id long, region_id int, entity_id string, selected boolean, replacement string")
    decided = spark.createDataFrame([(1, "a", "PHONE", "13812345678", True, None)], "doc_id long, entity_id string, entity_type string, value string, selected boolean, replacement string")
    out = review.propagate_to_regions(regions, decided, policy_rows(spark, (1, "EMAIL", "-")))
    assert sorted((r.region_id, r.selected, r.replacement) for r in out.collect()) == [(1, True, "138****5678"), (2, True, "mine"), (3, True, "own")]


def test_decisions_without_ids_are_foreign(spark):
    s = spark.createDataFrame([(1, None, True, None), (None, "a", True, None)], "doc_id long, entity_id string, selected boolean, replacement string")
    d = s.withColumn("replacement", F.lit("n"))
    assert sorted((str(r.doc_id), r.error) for r in review.decision_errors(s, d).collect()) == [("1", "FOREIGN"), ("None", "FOREIGN")]
    assert {r.replacement for r in review.apply_decisions(s, d).collect()} == {None}


def brute_terms(texts, known):
    found = set()
    for i, t in texts:
        for kind, term in known:
            at = (t or "").find(term)
            while at >= 0:
                found.add((i, kind, term, at, at + len(term)))
                at = t.find(term, at + len(term))
    return found


def test_seed_index_finds_every_term(spark):
    rnd = random.Random(7)
    letters = "ab中é😀 "
    texts = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 400)))) for i in range(60)] + [(60, None), (61, ""), (62, "x" * 500 + "a" * 300)]
    known = {("T", "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 12)))) for _ in range(300)}
    known |= {("U", texts[3][1][5:200]), ("U", texts[9][1][:130]), ("T", "aa"), ("U", "aa"), ("T", "a" * 120), ("T", "x" * 300 + "b"), ("T", texts[5][1])}
    known = {(k, t) for k, t in known if t}
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    terms_table = spark.createDataFrame([*known, ("T", ""), ("T", None)], "entity_type string, term string")
    found = detect.detect_terms(docs, terms_table).collect()
    got = [(r.doc_id, r.entity_type, r.value, r.start_at, r.end_at) for r in found]
    assert len(got) == len(set(got)) and set(got) == brute_terms(texts, known)
    assert detect.detect_terms(docs, terms_table.limit(0)).count() == 0 and detect.detect_terms(docs.limit(0), terms_table).count() == 0


def test_rules_beyond_the_plan_are_a_table(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta 13812345678"), (2, "gamma"), (3, None)], "doc_id long, text string")
    rules = rule_rows(spark, ("literal", "alpha"), ("dictionary", "beta\r\n gamma \n"), ("regex", "g[a-z]"), *[("literal", f"none {i}") for i in range(20)])
    policies = policy_rows(spark, (1, "T", "#"))
    want = sorted(map(tuple, redact.redact_texts(docs, rules, policies).collect()))
    spans_of = lambda: sorted(map(tuple, detect.detect_all(docs, rules).collect()))
    few = spans_of()
    monkeypatch.setattr(detect, "MOST_RULES", 5)
    assert sorted(map(tuple, redact.redact_texts(docs, rules, policies).collect())) == want and spans_of() == few
    assert want[0][1] == "# # 138****5678" and want[1][1] == "#"
    with pytest.raises(ValueError):
        detect.detect_rules(docs, rule_rows(spark, *[("regex", f"a{i}") for i in range(6)]))


def test_long_texts_are_cut_in_one_walk(spark):
    docs = spark.createDataFrame([(1, "ab😀" * 2_000_000), (2, None), (3, ""), (4, "x" * 401)], "doc_id long, text string").repartition(1)
    began = time.time()
    found = detect.chunk_text(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("size")).collect()
    assert {r.doc_id: (r.n, r.size) for r in found} == {1: (15_000, 15_000 * 450 - 50), 4: (2, 402)}
    marks = spark.createDataFrame([(1, "T", 3 * i, 3 * i + 2) for i in range(1000)], "doc_id long, entity_type string, start_at int, end_at int")
    parts = redact.redact_segments(docs.where("doc_id <> 4"), marks).collect()
    assert "".join(r.text for r in sorted(parts, key=lambda r: r.seg_start)) == "ab😀" * 2_000_000 and len(parts) == 2000
    assert time.time() - began < 60


def test_first_line_of_many(spark):
    rnd = random.Random(2)
    lines = [(d, n, a := rnd.randrange(60), a + rnd.randrange(25)) for d in range(6) for n in range(30)]
    entities = [(d, f"e{i}", a := rnd.randrange(60), a + rnd.randrange(12)) for d in range(7) for i in range(60)] + [(1, "none", None, 3), (None, "x", 1, 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    got = review.first_line_of(spark.createDataFrame(entities, "doc_id long, entity_id string, start_at int, end_at int"), spark.createDataFrame(lines, "doc_id long, line_no int, start_at int, end_at int")).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(d, e): min((n for ld, n, x, y in lines if None not in (d, a) and ld == d and x <= a and b <= y), default=None) for d, e, a, b in entities}
    assert {(r.doc_id, r.entity_id): r.line_no for r in got} == want and len(got) == len(entities)


def test_lines_of_a_long_document_are_swept(spark):
    began = time.time()
    marks = spark.range(100_000)
    lines = marks.select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("line_no"), (F.col("id") * 10).cast("int").alias("start_at"), (F.col("id") * 10 + 10).cast("int").alias("end_at"))
    own = marks.select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("string").alias("entity_id"), (F.col("id") * 10 + 3).cast("int").alias("start_at"), (F.col("id") * 10 + 7).cast("int").alias("end_at"))
    assert review.first_line_of(own, lines).where("cast(entity_id as int) = line_no").count() == 100_000
    assert time.time() - began < 30


def test_hits_of_a_crowded_page(spark):
    began, rnd = time.time(), random.Random(3)
    box = lambda: (x := rnd.random(), y := rnd.random(), x + rnd.random() / 50, y + rnd.random() / 50)
    hits = [(1, 0, i, rnd.choice("ab"), *box()) for i in range(20_000)]
    regions = [(1, 0, i, rnd.choice(["a ", "b", "c", " ", None]), *box()) for i in range(200)] + [(1, 0, 999, "a", 0.0, 0.0, 1.0, 1.0)]
    h = spark.createDataFrame(hits, "doc_id long, page int, hit_id int, text string, hx0 double, hy0 double, hx1 double, hy1 double")
    r = spark.createDataFrame(regions, "doc_id long, page int, region_id int, text string, x0 double, y0 double, x1 double, y1 double")
    boxes = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"h{c}") for c in ("x0", "y0", "x1", "y1"))
    got = {x.region_id: x.hit_id for x in review.best_hit(r, h, geometry.overlap_ratio(*boxes), *boxes).collect()}

    def ratio(a, b):
        w, t = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0), max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)
        return w * t / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * t)

    for _, _, i, text, *own in regions:
        best = max(((ratio(own, x[4:]), x[2]) for x in hits if text and x[3] == text.strip()), default=(0, None))
        assert got[i] == (best[1] if best[0] > 0 else None)
    assert time.time() - began < 60


def test_digest_of_texts_is_one_of_a_multiset(spark):
    of = lambda *t: spark.createDataFrame([(x,) for x in t], "text string").repartition(3).agg(audit.text_digest(F.col("text"))).first()[0]
    assert of("a", "b", "b", None) == of("b", "a", "b") != of("a", "b") and of("ab") != of("a", "b") and len({of("a", "a"), of("a"), of(None)}) == 3


def test_fragments_and_spans_meet_once(spark, tmp_path):
    rnd = random.Random(8)
    parts, marks, want = [], [], {}
    for d in range(5):
        texts = ["".join(rnd.choice("ab😀中") for _ in range(rnd.randrange(6))) for _ in range(9)]
        whole, at = "-".join(texts), 0
        while at < len(whole):
            end = at + rnd.randrange(1, 9)
            if rnd.random() < 0.6 and end <= len(whole):
                marks.append((d, at, end, f"<{at}>"))
            at = end
        cut = list(whole)
        for _, a, b, r in [m for m in marks if m[0] == d]:
            cut[a:b] = [""] * (b - a)
        lo = 0
        for n, t in enumerate(texts):
            own = [m for m in marks if m[0] == d]
            out = "".join("".join(r for _, a, _, r in own if a == lo + i) + cut[lo + i] for i in range(len(t)))
            want[d, n], lo = out, lo + len(t) + 1
            parts.append((d, n, t))
    spark.createDataFrame(parts, "doc_id long, frag_no int, text string").write.parquet(str(tmp_path / "f"))
    spark.createDataFrame(marks, "doc_id long, start_at int, end_at int, replacement string").write.parquet(str(tmp_path / "m"))
    out = redact.redact_fragments(spark.read.parquet(str(tmp_path / "f")), spark.read.parquet(str(tmp_path / "m")), "-")
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 2 and plan.count("Exchange ") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    assert {(r.doc_id, r.frag_no): r.redacted for r in out.collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    nulls = redact.redact_fragments(spark.createDataFrame([(1, 0, None), (1, 1, "abc")], "doc_id long, frag_no int, text string"), spark.createDataFrame([(1, 1, 2, None)], "doc_id long, start_at int, end_at int, replacement string"))
    assert {r.frag_no: r.redacted for r in nulls.collect()} == {0: None, 1: "ac"}


def test_tag_paths_of_many_sequences(spark):
    import itertools

    rnd = random.Random(6)
    k, start, end = 3, [0.5, 0.0, -1.0], [0.0, 0.25, 0.5]
    moves = [[rnd.choice([0.0, 0.5, -1.0]) for _ in range(k)] for _ in range(k)]
    seqs = {i: [[rnd.choice([0.0, 1.0, 0.5]) for _ in range(k)] for _ in range(rnd.randrange(1, 7))] for i in range(40)}
    rows = [(i, p, v) for i, s in seqs.items() for p, v in enumerate(s)] + [(100, 0, [1.0, None, 2.0]), (101, 0, [1.0, 2.0]), (101, 1, [1.0, 2.0, 3.0]), (102, 0, None), (103, 0, [1.0, float("inf"), 2.0])]
    e = spark.createDataFrame(rows, "seq_id long, pos int, values array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    got = sequence.decode_tag_path(e, start, end, moves).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    value = lambda s, p: start[p[0]] + sum(s[i][t] for i, t in enumerate(p)) + sum(moves[a][b] for a, b in zip(p, p[1:], strict=False)) + end[p[-1]]
    for i, s in seqs.items():
        path = [r.tag for r in sorted((r for r in got if r.seq_id == i), key=lambda r: r.pos)]
        assert len(path) == len(s) and value(s, path) == max(value(s, p) for p in itertools.product(range(k), repeat=len(s)))
    assert sorted(r.seq_id for r in got if r.pos is None) == [100, 101, 102, 103]


def test_long_sequences_take_linear_time(spark):
    began = time.time()
    e = spark.range(200_000).select(F.lit(1).alias("seq_id"), F.col("id").cast("int").alias("pos"), F.array(F.rand(1), F.rand(2)).alias("values"))
    assert sequence.decode_tag_path(e, [0.0, 0.0], [0.0, 0.0], [[0.0, -0.1], [-0.1, 0.0]]).count() == 200_000
    assert time.time() - began < 40


def test_offsets_of_many_spans_of_a_long_text(spark):
    began = time.time()
    docs = spark.createDataFrame([(1, "aé中😀" * 500_000), (2, None)], "doc_id long, text string")
    marks = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 40 + 2).cast("int").alias("start_at"), (F.col("id") * 40 + 4).cast("int").alias("end_at")).unionByName(spark.createDataFrame([(2, 0, 1)], "doc_id long, start_at int, end_at int"))
    found = spans.located(marks, docs)
    n = F.col("start_at") - 2
    right = (F.col("value") == "中😀") & (F.col("start_byte") == n / 4 * 10 + 3) & (F.col("end_byte") == n / 4 * 10 + 10) & (F.col("start_utf16") == n / 4 * 5 + 2) & (F.col("end_utf16") == n / 4 * 5 + 5)
    assert found.where(right).count() == found.count() == 50_000
    assert time.time() - began < 40
