"""One query for each corpus operator, with production parameters and whole tables."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from desense.llm import ann, bpe, jaccard_join, language_id, licence_scan, minhash, oracles, packing, quality, token_alignment, token_files, token_rollup, url_filter, whitening
from desense.llm.common import scratch, table, written

#: Rules and the host labels whose urls are listed.
URL_RULES = [
    url_filter.UrlRule("block", "net", "/"),
    url_filter.UrlRule("allow", "example.net", "/en/"),
    url_filter.UrlRule("block", "example.com", "/de/"),
    url_filter.UrlRule("allow", "org", "/fr/"),
]
LISTED_LABELS = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.in_holdout(F.col("doc_id")))
    model = language_id.fit_language_model(docs.where("not held_out").select("text", "lang"))
    judged = language_id.predict_language(docs, model, ["doc_id", "held_out"])
    return judged.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = url_filter.url_parts(F.col("url"))[0]
    listed = pages.where(host.rlike(rf"(^|\.)({'|'.join(LISTED_LABELS)})\.")).select("url")
    return url_filter.url_filter(pages, listed, URL_RULES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *quality.STATS, "base_failed", "kept")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    return packing.pack(token_files.token_counts(table(spark, sf_dir, "documents"), vocabulary))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary, ["doc_id"])


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan_licences(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    path = scratch(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary, path)
    return token_files.read_token_files(spark, path)


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"), vocabulary, model)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts under v1, then v2 counts where they differ, then deletes of exact copies;
    the first two batches are delivered twice."""
    docs = written(table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.when(F.col("text").isNotNull(), F.xxhash64("text", F.length("text"))).alias("h"),
        F.regexp_count("text", F.lit(oracles.V1)).alias("v1"), F.regexp_count("text", F.lit(oracles.V2)).alias("v2"),
    ))
    count = lambda df, v: df.select("source", "lang", F.lit(f"words-{v}").alias("tokenizer_version"), F.col(v).alias("n_tokens"))
    changed = docs.where("v1 <> v2")
    # written, so that the join can split a large group of equal texts
    first = docs.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = written(first.where("n > 1").drop("n"))
    copies = docs.join(first, "h").where("doc_id > first_id")
    rollup = token_rollup.TokenRollup(spark, scratch(spark))
    inserts = token_rollup.signed(count(docs, "v1"), 1)
    revisions = token_rollup.revised(count(changed, "v1"), count(changed, "v2"))
    deletes = token_rollup.signed(count(copies.where("v1 = v2"), "v1").unionByName(count(copies.where("v1 <> v2"), "v2")), -1)
    for batch_id, changes in [(1, inserts), (2, revisions), (1, inserts), (3, deletes), (2, revisions)]:
        rollup.commit(batch_id, changes)
    return rollup.totals()


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_url_filters": op2_url_filters,
    "op3_quality_rules": op3_quality_rules,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_bpe": op5_bpe,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_licence_scan": op7_licence_scan,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_token_counts": op9_token_counts,
    "op10_token_files": op10_token_files,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE = {
    "op2_url_filters": oracles.OP2,
    "op3_quality_rules": oracles.op3(),
    "op9_token_counts": oracles.OP9,
}
