"""Name → query and name → oracle SQL of the masking operators."""

from __future__ import annotations

from desense.plans import masking, safekeeping, workflow

QUERIES: dict = {**masking.QUERIES, **workflow.QUERIES, **safekeeping.QUERIES}
ORACLE: dict = {**masking.ORACLE, **workflow.ORACLE, **safekeeping.ORACLE}
