"""Rollup commits: replays, attempts that die between any two steps, compaction."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from desense.llm import token_rollup

ROW = "source string, lang string, tokenizer_version string, n_tokens long"


@pytest.fixture
def rollup(spark, tmp_path):
    return token_rollup.TokenRollup(spark, str(tmp_path / "r"))


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([("s", "en", "v1", 5), (None, None, "v1", None)], ROW)


def sums(rollup):
    return {r.source: (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_replays_change_nothing(rollup, rows):
    for _ in range(2):
        rollup.commit(1, token_rollup.signed(rows, 1))
    rollup.commit(2, token_rollup.revised(rows.limit(1), rows.limit(1).withColumn("n_tokens", F.lit(9))))
    rollup.commit(3, token_rollup.signed(rows, 1).limit(0))
    late = rollup.write_attempt(token_rollup.signed(rows, 1))
    assert not rollup.publish("commits", "1", late)
    assert sums(rollup) == {"s": (1, 9), None: (1, 0)}


def test_a_store_without_commits(rollup, rows):
    assert sums(rollup) == {} and not rollup.compact()
    rollup.write_attempt(token_rollup.signed(rows, 1))
    assert sums(rollup) == {}
    rollup.vacuum()


class Died(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "create", "fill", "mkdirs", "rename"])
def test_an_attempt_that_dies_leaves_the_batch_free(rollup, rows, monkeypatch, step):
    """The first attempt dies before the step; the second counts, once."""
    rollup.commit(1, token_rollup.signed(rows, 1))

    def dies(*_, **__):
        raise Died

    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(rollup, "write_attempt", dies)
        elif step == "create":
            m.setattr(rollup, "publish", dies)
        else:
            at = rollup._at

            class Target:
                """A target path whose file system dies at the step."""

                def __init__(self, path):
                    self.path = path

                def getFileSystem(self, conf):  # noqa: N802
                    files = self.path.getFileSystem(conf)
                    if step == "fill":
                        return type("Files", (), {"create": lambda _, w, o: (files.create(w, o).close(), dies())})()
                    return type("Files", (), {"create": lambda _, w, o: files.create(w, o), "mkdirs": dies})()

                def getParent(self):  # noqa: N802
                    return self.path.getParent()

            if step == "rename":
                m.setattr(rollup.spark.sparkContext._gateway, "new_array", dies)
            else:
                m.setattr(rollup, "_at", lambda name: Target(at(name)) if name == "commits/2" else at(name))
        with pytest.raises(Died):
            if step in ("write", "create"):
                rollup.commit(2, token_rollup.signed(rows, 1))
            else:
                rollup.publish("commits", "2", rollup.write_attempt(token_rollup.signed(rows, 1)))
    assert sums(rollup) == {"s": (1, 5), None: (1, 0)}
    for _ in range(2):
        rollup.commit(2, token_rollup.signed(rows, 1))
    assert sums(rollup) == {"s": (2, 10), None: (2, 0)}


def test_an_empty_commit_file_is_none(rollup, rows):
    rollup.commit(1, token_rollup.signed(rows, 1))
    target = rollup._at("commits/2")
    target.getFileSystem(rollup.spark.sparkContext._jsc.hadoopConfiguration()).create(target, False).close()
    assert sums(rollup)["s"] == (1, 5)
    rollup.commit(2, token_rollup.signed(rows, 1))
    assert sums(rollup)["s"] == (2, 10)


def test_compaction_keeps_totals_and_batches(rollup, rows):
    for n in range(1, 4):
        rollup.commit(n, token_rollup.signed(rows, 1))
    assert rollup.compact() and not rollup.compact()
    rollup.commit(2, token_rollup.signed(rows, 1))
    rollup.commit(4, token_rollup.signed(rows, -1))
    want = {"s": (2, 10), None: (2, 0)}
    assert sums(rollup) == want
    assert rollup.compact() and sums(rollup) == want
    rollup.vacuum()
    assert sums(rollup) == want and rollup._published("commits") == {} and len(rollup._published("bases")) == 1
    # an attempt that found its batch free before it was compacted comes to commit now
    rollup.publish("commits", "3", rollup.write_attempt(token_rollup.signed(rows, 1)))
    rollup.commit(1, token_rollup.signed(rows, 1))
    assert sums(rollup) == want


def test_two_compactions_at_once(rollup, rows, monkeypatch):
    rollup.commit(1, token_rollup.signed(rows, 1))
    base = rollup._base()
    assert rollup.compact()
    monkeypatch.setattr(rollup, "_base", lambda: base)
    assert not rollup.compact()
    monkeypatch.undo()
    assert sums(rollup) == {"s": (1, 5), None: (1, 0)}


def test_odd_input(rollup, spark):
    counted = spark.createDataFrame([("s", "en", "v", 10**12, 1), ("s", "en", "v", 10**12, 2)], ROW + ", docs long").withColumn("tokens", F.lit(7)).withColumn("batch_id", F.lit("x"))
    rollup.commit(1, token_rollup.signed(counted, 1))
    assert sums(rollup) == {"s": (2, 2 * 10**12)}
