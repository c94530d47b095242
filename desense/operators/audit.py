"""Audits: leaks after redaction, file integrity, differences of annotations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from desense.operators.detect import detect_all


def leak_audit(redacted: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected values still found in their document's redacted text: those are blocked."""
    values = selected.select("doc_id", "entity_type", "value").distinct()
    return values.join(redacted.select("doc_id", "redacted"), "doc_id").where(F.contains("redacted", F.col("value"))).select("doc_id", "entity_type", "value")


def block_leaks(redacted: DataFrame, selected: DataFrame) -> DataFrame:
    """The redacted documents; one in which a selected value is still found fails, and no
    text of it comes out."""
    leaks = leak_audit(redacted, selected).select("doc_id").distinct().withColumn("_leak", F.lit(True))
    rows = redacted.join(leaks, "doc_id", "left")
    return rows.select(
        "doc_id", F.when(F.col("_leak").isNull(), F.col("redacted")).alias("redacted"), F.when(F.col("_leak").isNull(), F.col("n_spans")).otherwise(0).alias("n_spans"),
        F.when(F.col("_leak"), "LEAK").otherwise(F.col("error")).alias("error"),
    )


def residual_rescan(redacted: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """What detectors still find in redacted texts: (entity_type, n)."""
    docs = redacted.select("doc_id", F.col("redacted").alias("text"))
    return detect_all(docs, rules).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


#: Characters that a name in a manifest must not hold, or not end with.
BAD_NAME = r"[/\\:]|[. ]$"
MOST_MANIFEST_BYTES = 2 << 30


def integrity_audit(manifest: DataFrame, files: DataFrame, most_bytes: int = MOST_MANIFEST_BYTES) -> DataFrame:
    """(name, verdict): manifest (name, size_bytes, sha256) against files (name, content)
    by name without case: ok, bad_name, listed_twice, missing, extra, duplicate, size or
    hash; and a row without a name where the manifest's total is too large."""
    key = F.lower("name")
    bad = (F.col("name") == "") | F.col("name").rlike(BAD_NAME)
    m = manifest.groupBy(key.alias("name")).agg(F.count(F.lit(1)).alias("times"), F.max("size_bytes").alias("want"), F.max("sha256").alias("sha256"), F.bool_or(bad).alias("bad"))
    f = files.select(key.alias("name"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"))
    f = f.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("hash").alias("hash"))
    verdict = (
        F.when(F.col("bad"), "bad_name").when(F.col("times") > 1, "listed_twice").when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("n") > 1, "duplicate")
        .when(F.col("size") != F.col("want"), "size").when(F.col("hash") != F.col("sha256"), "hash").otherwise("ok")
    )
    total = manifest.agg(F.sum("size_bytes").alias("total")).where(F.col("total") > most_bytes)
    return m.join(f, "name", "full").select("name", verdict.alias("verdict")).unionByName(total.select(F.lit(None).cast("string").alias("name"), F.lit("total_too_large").alias("verdict")))


def text_digest(text: Column) -> Column:
    """Digest of a group's texts as a multiset, an aggregate: the eight words of each text's
    SHA-256 are summed, and the sums and the number of texts hashed. Sums add up from parts,
    so no task holds a group; they stay exact for 2**31 texts. Null texts are left out."""
    words = [F.conv(F.substring(F.sha2(text, 256), 8 * k + 1, 8), 16, 10).cast("long") for k in range(8)]
    sums = [F.coalesce(F.sum(w), F.lit(0)).cast("string") for w in words]
    return F.sha2(F.concat_ws(",", F.count(text).cast("string"), *sums), 256)


def ordered_hash(texts: DataFrame, by: list[str]) -> DataFrame:
    """(*by, output_hash): for each group the SHA-256 of the hexadecimal SHA-256 of all its
    texts, in order, one after another; of none where all texts are null: null.

    Such a hash is one sequence for a group by its nature. Spark sorts the hashes, on disk where
    they are many, and a task passes them through one after another and holds a batch."""
    rows = texts.select(*by, F.sha2("text", 256).alias("_hash")).repartition(*by).sortWithinPartitions(*by, "_hash")
    schema = StructType([*(texts.schema[c] for c in by), StructField("output_hash", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, some = None, None, False

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, digest.hexdigest() if some else None), strict=True))], schema=arrow)

        for batch in batches:
            for *own, text in zip(*(batch.column(c).to_pylist() for c in (*by, "_hash")), strict=True):
                if own != key:
                    if key is not None:
                        yield done()
                    key, digest, some = own, hashlib.sha256(), False
                if text is not None:
                    digest.update(text.encode())
                    some = True
        if key is not None:
            yield done()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(run, schema)


def acceptance_summary(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """For each source and mode of redacted documents (doc_id, source, mode, text, pages,
    elapsed_ms): documents, pages, spans by type as JSON, bytes, elapsed time, and a hash of
    all texts' hashes in order (``ordered_hash``)."""
    by = ["source", "mode"]
    typed = docs.select("doc_id", *by).join(spans.select("doc_id", "entity_type"), "doc_id").groupBy(*by, "entity_type").agg(F.count(F.lit(1)).alias("n"))
    counts = typed.groupBy(*by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n"))))).alias("entities"))
    whole = docs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("pages").cast("long")).alias("pages"),
        F.sum(F.octet_length("text").cast("long")).alias("output_bytes"), F.sum("elapsed_ms").alias("elapsed_ms"),
    )
    hashes = ordered_hash(docs, by)
    same = [whole[c].eqNullSafe(hashes[c]) for c in by]
    return whole.join(hashes, same[0] & same[1]).select(*[whole[c] for c in whole.columns], "output_hash").join(counts, by, "left")


def annotation_diff(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Differences by ordinal within a case: (doc_id, n, verdict), agreeing ones left out."""
    order = Window.partitionBy("doc_id").orderBy("start_at", "end_at", "entity_id")
    e, a = (df.select("doc_id", F.row_number().over(order).alias("n"), F.struct("entity_type", "start_at", "end_at", "score").alias(c)) for df, c in ((expected, "e"), (actual, "a")))
    rows = e.join(a, ["doc_id", "n"], "full")
    verdict = (
        F.when(F.col("e").isNull() | F.col("a").isNull(), "count").when(F.col("e.entity_type") != F.col("a.entity_type"), "type")
        .when((F.col("e.start_at") != F.col("a.start_at")) | (F.col("e.end_at") != F.col("a.end_at")), "span")
        .when(F.abs(F.col("e.score") - F.col("a.score")) > tolerance, "score")
    )
    return rows.select("doc_id", F.col("n").cast("int").alias("n"), verdict.alias("verdict")).where("verdict is not null")
