"""Shared helpers of the corpus operators: scratch tables and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from desense.sources.inputs import spread

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six white-space characters between words, as a body of a character class.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"

_own_scratch: dict[str, str] = {}
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, the folder that driver and
    executors share; a cluster must name it. In a single JVM without one, any folder of the
    machine is shared."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own_scratch[app] = _own_scratch.get(app) or tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{base.rstrip('/')}/desense-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder: lineage ends
    there, and a lost executor costs no more than a new read."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _path_of[back] = path
    return back


def released(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave out, once no plan that is still to run reads
    them. Everything else stays as it is."""
    for df in tables:
        if path := _path_of.pop(df, None):
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def refuse_clashes(keep: Iterable[str], made: Iterable[str]) -> None:
    """Columns to keep may not have the names of columns that an operator makes."""
    if both := sorted(set(keep) & set(made)):
        raise ValueError(f"columns to keep have names of results: {both}")


def ascii_lower(text: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the maximal runs without white space; empty for null or blank texts."""
    trimmed = F.regexp_replace(text, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{SPACE_CLASS}]+")
    )


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece has about ``most`` bytes of text at most
    (one row is never cut), to bound what vectorised code allocates at a time."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, start, total = np.cumsum(lengths), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, total + most, side="right")))
            yield batch.slice(start, stop - start)
            start, total = stop, int(ends[stop - 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more at the end);
    null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, never across two texts, and for each
    text the number of its first run (one more at the end)."""
    if not len(is_word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[filled] = is_word[filled]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = is_word[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, offsets)
