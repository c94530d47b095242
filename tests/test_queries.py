"""Every masking query against its oracle on the smallest tables."""

from __future__ import annotations

import pytest
from compare import SF_DIR, assert_same, connect

from desense.plans import registry


def test_every_query_has_an_oracle():
    assert registry.QUERIES.keys() == registry.ORACLE.keys()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    assert_same(registry.QUERIES[name](spark, SF_DIR), connect(SF_DIR), registry.ORACLE[name])
