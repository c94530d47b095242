"""Edits of stored tables: each is one commit on the version it was made on.

Tables of the store: ``policies``, ``rules``, ``spans``, ``reviews``, ``regions``. An edit
names the version it saw; where another was committed since, it is refused as a whole
(``Conflict``), whatever it touches. The returned errors are those of refused rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from desense.operators import review
from desense.sources.store import Store


def save_policies(store: Store, seen: int, edits: DataFrame) -> int:
    """Policies upserted by type."""
    return store.commit(seen, "policies", policies=review.upsert_policies(store.read("policies", seen), edits))


def save_rules(store: Store, seen: int, edits: DataFrame) -> int:
    """Rules upserted, and default policies of their new types, in one version."""
    rules, policies = review.save_rules(store.read("rules", seen), store.read("policies", seen), edits)
    return store.commit(seen, "rules", rules=rules, policies=policies)


def delete_rules(store: Store, seen: int, ids: DataFrame) -> int:
    return store.commit(seen, "rules", rules=review.delete_rules(store.read("rules", seen), ids))


def save_decisions(store: Store, seen: int, decisions: DataFrame) -> tuple[int, DataFrame]:
    """Decisions on spans, with the reviews of their documents, in one version."""
    spans, reviews, errors = review.save_decisions(store.read("spans", seen), decisions, store.read("reviews", seen))
    return store.commit(seen, "decisions", spans=spans, reviews=reviews), errors


def save_regions(store: Store, seen: int, edits: DataFrame) -> tuple[int, DataFrame]:
    """Regions marked by hand, with the reviews of their documents, in one version."""
    regions, reviews, errors = review.upsert_regions(store.read("regions", seen), edits, store.read("reviews", seen))
    return store.commit(seen, "regions", regions=regions, reviews=reviews), errors


def remove_regions(store: Store, seen: int, removals: DataFrame) -> tuple[int, DataFrame]:
    regions, reviews, errors = review.remove_regions(store.read("regions", seen), removals, store.read("reviews", seen))
    return store.commit(seen, "regions", regions=regions, reviews=reviews), errors
