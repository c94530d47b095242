"""Patterns without backtracking: the same matches as Python's engine has, in linear time."""

from __future__ import annotations

import random
import re
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from desense.functions.linear import marked, needs_linear, to_linear
from desense.functions.matching import MARK
from desense.operators import detect, redact


def spans(pattern, text):
    parts, at, out = marked(pa.array([text]), to_linear(pattern))[0], 0, []
    for i, p in enumerate(parts):
        if i % 2:
            out.append((at, p))
        at += len(p)
    assert "".join(parts) == text
    return out


ATOMS = st.sampled_from(["a", "b", "ab", "[ab]", "[^a]", r"\d", r"\w", r"\s", r"\D", r"[\d_]", ".", r"\.", "é", "中", "(?:a|b1)", "(ab?)"])
PATTERNS = st.lists(st.tuples(ATOMS, st.sampled_from(["", "", "+", "*", "?", "{2}", "{1,3}", "+?", "{2,}"])), min_size=1, max_size=4).map(lambda p: "".join(a + n for a, n in p))


@settings(max_examples=300, deadline=None)
@given(PATTERNS, st.text("ab1. _é中٣\n" + MARK, max_size=25))
def test_matches_are_those_of_a_backtracking_engine(pattern, text):
    if re.match(pattern, ""):
        return
    assert spans(pattern, text) == [(m.start(), m.group()) for m in re.finditer(pattern, text)]


@pytest.mark.parametrize("pattern", [r"\bword", "a++", "(?i)a+", "[a-z&&[b]]", r"(a)\1", "a{2000,}", "(?<=a)b+", r"\x41+", "[[:alpha:]]+", "a{400}b{400}c+"])
def test_what_the_engine_has_no_like_of(pattern):
    assert to_linear(pattern) is None


@pytest.mark.parametrize("pattern", ["(a+)+$", "(a|a)*b", "([a-z]+)*@x", "[a-z]+[a-z]+[a-z]+!", "(.*)(.*)(.*)(.*)9$"])
def test_patterns_that_would_never_end(spark, pattern):
    assert needs_linear(pattern)
    began = time.time()
    docs = spark.createDataFrame([(1, "a" * 200_000 + " 5"), (2, "zaab!x@x a")], "doc_id long, text string")
    rules = spark.createDataFrame([(1, "n", "T", "regex", pattern, True)], "rule_id long, name string, entity_type string, kind string, pattern string, enabled boolean")
    policies = spark.createDataFrame([(1, "T", "#")], "policy_id long, entity_type string, replacement string")
    out = {r.doc_id: r.redacted for r in redact.redact_texts(docs, rules, policies).collect()}
    assert out[1] == docs.first().text and time.time() - began < 30
    assert out[2] == re.sub(pattern, "#", "zaab!x@x a")


def test_both_engines_find_the_same(spark):
    rnd = random.Random(4)
    texts = [(i, "".join(rnd.choice("ab1. _é中٣\n") for _ in range(40))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rules = [(n, "n", "T", "regex", p, True) for n, p in enumerate([r"\w+\d", r"[ab]+\s", r"\S+é", "(?:a|b1)+", r"[^\d\s]{2,}中"])]
    kind = "rule_id long, name string, entity_type string, kind string, pattern string, enabled boolean"
    fast = sorted(map(tuple, detect.detect_rules(docs, spark.createDataFrame(rules, kind)).collect()))
    # a pattern in a group that only Java knows is searched by Java
    slow = sorted(map(tuple, detect.detect_rules(docs, spark.createDataFrame([(*r[:4], f"(?>){r[4]}", True) for r in rules], kind)).collect()))
    assert fast == slow and len(fast) > 300


def test_the_end_is_the_end_of_the_text(spark):
    docs = spark.createDataFrame([(1, "xa\n"), (2, "xa")], "doc_id long, text string")
    rules = spark.createDataFrame([(1, "n", "T", "regex", "a$", True)], "rule_id long, name string, entity_type string, kind string, pattern string, enabled boolean")
    assert [r.doc_id for r in detect.detect_rules(docs, rules).collect()] == [2]
