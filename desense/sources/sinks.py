"""Sinks: redacted documents and counts-only reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_redacted(redacted: DataFrame, path: str) -> None:
    """Publish (doc_id, redacted) as Parquet, never over an existing result; Spark's
    committer shows all of it or nothing. Failed documents are not published."""
    redacted.where("error is null").select("doc_id", "redacted").write.mode("errorifexists").parquet(path)


def reports(jobs: DataFrame, counts: DataFrame) -> DataFrame:
    """(job_id, report): one JSON object for each job (job_id, kind, state, output_path) with
    its counts (job_id, entity_type, n) by type, and no text or value."""
    by_type = counts.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("entity_counts"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    fields = F.struct(F.lit(1).alias("version"), "job_id", "kind", "state", F.coalesce("entity_counts", none).alias("entity_counts"), "output_path")
    return jobs.join(by_type, "job_id", "left").select("job_id", F.to_json(fields).alias("report"))


def write_report(reports: DataFrame, path: str) -> None:
    """Publish one JSON report a line."""
    reports.select("report").write.mode("errorifexists").text(path)
