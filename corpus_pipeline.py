"""The corpus pipeline: quality rules, language ID, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All
but the last return the columns of ``documents``; the last returns the packing table.

Defined cases: texts that are null, empty or without words go in the first stage, texts
without a letter in the second. Rows with a null id or a repeated one are judged like all
others by the first two stages; the third keeps all rows with a null id, and of one id a
row for each group of near duplicates; the last has a row without a bin for a null id.
A very long text is one row, and several pieces in the last stage. An empty table gives an
empty result; extra columns, whatever their names, are carried to the last stage.
"""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from desense.llm import jaccard_join, language_id, packing, quality, token_files
from desense.llm.common import table, written

#: Near duplicates: words in a shingle, and the similarity as a ratio of whole numbers.
SHINGLE, OVER, UNDER = 5, 80, 100
#: The vocabulary whose tokens are packed.
VOCABULARY = "byte_bpe_50k.json"
#: Packing is greedy, which SQL cannot express; tests hold ``run`` against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers."""
    return quality.passing(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a sufficient margin."""
    labelled = docs.where(~language_id.in_holdout(F.col("doc_id"))).select("text", "lang")
    model = language_id.fit_language_model(labelled)
    return language_id.predict_language(docs, model, docs.columns, accepted_only=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, once, whatever
    else has that id; rows without an id, which can't be told apart, all stay."""
    return jaccard_join.first_documents(docs, SHINGLE, OVER, UNDER)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies in the training sequences, by its number of tokens."""
    vocabulary = Path(public_tokenizers.path(VOCABULARY)).read_text(encoding="utf-8")
    return packing.pack(token_files.token_counts(docs, vocabulary))


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as a table and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
