from __future__ import annotations

import __spark_entry__ as entry


def test_entry_points(spark):
    names = entry.queries().keys()
    assert entry.oracle_sql().keys() <= names
    assert entry.entry(spark).columns == ["doc_id", "redacted", "n_spans", "error"]
