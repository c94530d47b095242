"""Regex matches in a text column, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands around matches while they are told from what is between them: no character.
MARK = "\uFDD0"


def cut(text: Column, pattern: str, holds: str = "") -> Column:
    """What stands before, in and after the matches of a pattern, by turns; null without a
    match. The pattern is compiled once. Where every match holds a certain text, only texts
    that contain it are searched.

    Matches are marked in one run over the text, which is then split at the marks; only a
    text that has the mark itself is run over once for what is between and once for matches.
    """
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    slow = F.flatten(F.transform(F.arrays_zip(between.alias("a"), F.concat(matches, F.array(F.lit(""))).alias("b")), lambda x: F.array(x["a"], x["b"])))
    fast = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    found = F.rlike(text, F.lit(pattern))
    return F.when(F.contains(text, F.lit(holds)) & found if holds else found, F.when(F.contains(text, F.lit(MARK)), slow).otherwise(fast))


def lengths(parts: Column) -> Column:
    """How many code points stand before, in and after the matches, by turns, of what ``cut``
    gave: all that is needed to find them in their text again."""
    return F.transform(parts, F.length)
