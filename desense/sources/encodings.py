"""Bytes of text files to text and back, in five encodings.

UTF-8 is decoded by expressions. UTF-16 and GBK go to a pandas function: Spark's decoder
does not offer GBK, and stops the job where UTF-16 is malformed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

MARKS = {"utf-16le": bytes([0xFF, 0xFE]), "utf-16be": bytes([0xFE, 0xFF]), "utf-8-bom": bytes([0xEF, 0xBB, 0xBF]), "utf-8": b"", "gbk": b""}


@pandas_udf(StringType())
def _decoded(content: pd.Series, encoding: pd.Series) -> pd.Series:
    """Strictly decoded bytes after their mark; null if they are not of the encoding."""

    def one(b, name):
        try:
            return None if b is None else bytes(b)[len(MARKS[name]) :].decode(name)
        except UnicodeDecodeError:
            return None

    return pd.Series([one(b, n) for b, n in zip(content, encoding, strict=True)], dtype=object)


@pandas_udf(BinaryType())
def _gbk_bytes(text: pd.Series) -> pd.Series:
    def one(t):
        try:
            return None if t is None else t.encode("gbk")
        except UnicodeEncodeError:
            return None

    return text.map(one)


def encoding_of(content: Column) -> Column:
    starts = lambda m: F.substring(content, 1, len(m)) == F.lit(m)
    out = F.when(starts(MARKS["utf-16le"]), "utf-16le").when(starts(MARKS["utf-16be"]), "utf-16be").when(starts(MARKS["utf-8-bom"]), "utf-8-bom")
    return out.when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("gbk")


def decode_corpus(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, encoding) of rows (doc_id, content), and a quarantine (doc_id,
    error): undecodable, or with a NUL. A replacement character that is really there stays."""
    named = raw.where("content is not null").select("doc_id", "content", encoding_of(F.col("content")).alias("encoding"))
    body = F.when(F.col("encoding") == "utf-8-bom", F.expr("substring(content, 4)")).otherwise(F.col("content")).cast("string")
    utf8 = F.col("encoding").isin("utf-8", "utf-8-bom")
    native = named.where(utf8).withColumn("text", F.when(F.is_valid_utf8(body), body))
    other = named.where(~utf8).withColumn("text", _decoded("content", "encoding"))
    rows = native.unionByName(other)
    error = F.when(F.col("text").isNull(), "UNDECODABLE").when(F.contains("text", F.lit("\0")), "NUL")
    rows = rows.withColumn("error", error)
    none = raw.where("content is null").select("doc_id", F.lit("UNDECODABLE").alias("error"))
    return rows.where("error is null").select("doc_id", "text", "encoding"), rows.where("error is not null").select("doc_id", "error").unionByName(none)


def encode_corpus(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, content) of rows (doc_id, text, encoding) in their own encoding, mark
    included; and (doc_id, error) of texts that GBK cannot write."""
    text, code = F.col("text"), F.col("encoding")
    mark = lambda e: F.lit(MARKS[e])
    le = F.concat(mark("utf-16le"), F.encode(text, "UTF-16LE"))
    be = F.concat(mark("utf-16be"), F.encode(text, "UTF-16BE"))
    bom = F.concat(mark("utf-8-bom"), text.cast("binary"))
    rest = docs.where(code != "gbk").select("doc_id", F.when(code == "utf-16le", le).when(code == "utf-16be", be).when(code == "utf-8-bom", bom).otherwise(text.cast("binary")).alias("content"))
    gbk = docs.where(code == "gbk").select("doc_id", _gbk_bytes("text").alias("content"))
    return rest.unionByName(gbk.where("content is not null")), gbk.where("content is null").select("doc_id", F.lit("UNENCODABLE").alias("error"))
