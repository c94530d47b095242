"""A reversible vault: originals sealed with AES-GCM, recoverable with the key alone.

A sealed value is bound to its document and part by the associated data, a chunk also
to the total length, its index and whether it is the last. Anything moved, cut or
altered fails to open. Keys come from the caller and are 16, 24 or 32 bytes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

CHUNK_BYTES = 1 << 20


def _aad(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")


def _sealed(value: Column, key: bytes, aad: Column) -> Column:
    return F.call_function("aes_encrypt", value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)


def _opened(value: Column, key: bytes, aad: Column) -> Column:
    return F.call_function("try_aes_decrypt", value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad)


def vault_seal(values: DataFrame, key: bytes) -> DataFrame:
    """(id, part, sealed) of rows (id, part, content)."""
    return values.select("id", "part", _sealed(F.col("content"), key, _aad(F.col("id"), F.col("part"))).alias("sealed"))


def vault_open(sealed: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """(id, part, content), and (id, part, error) of what does not authenticate."""
    rows = sealed.select("id", "part", _opened(F.col("sealed"), key, _aad(F.col("id"), F.col("part"))).alias("content"))
    return rows.where("content is not null"), rows.where("content is null").select("id", "part", F.lit("AUTHENTICATION_FAILED").alias("error"))


def vault_chunks(values: DataFrame, key: bytes, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(id, n, total, last, sealed): large values in sealed chunks; an empty value has one."""
    total = F.octet_length("content").cast("long")
    count = F.greatest(F.ceil(total / chunk).cast("int"), F.lit(1))
    # pieces are cut within the row, so no row has more than its own piece
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda n: F.substring("content", n * chunk + 1, F.lit(chunk)))
    rows = values.select("id", total.alias("total"), count.alias("k"), F.posexplode(cut).alias("n", "piece"))
    rows = rows.select("id", "n", "total", (F.col("n") == F.col("k") - 1).alias("last"), "piece")
    aad = _aad(F.col("id"), F.col("total"), F.col("n"), F.col("last"))
    return rows.select("id", "n", "total", "last", _sealed(F.col("piece"), key, aad).alias("sealed"))


@F.arrow_udf(BinaryType())
def _joined(pieces: pa.Array) -> pa.Array:
    """The pieces of each value, one after the other; null where one is missing."""
    return pa.array([None if p is None or None in p else b"".join(p) for p in pieces.to_pylist()], pa.binary())


def vault_restore(chunks: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """(id, content), and (id, error) where a chunk is missing, extra, moved or altered.
    A value has a bounded number of chunks, so they meet in one group."""
    aad = _aad(F.col("id"), F.col("total"), F.col("n"), F.col("last"))
    rows = chunks.select("id", "n", "total", "last", _opened(F.col("sealed"), key, aad).alias("piece"))
    pieces = F.array_sort(F.collect_list(F.struct("n", "piece")))
    content = _joined(F.transform(pieces, lambda p: p["piece"]))
    whole = F.bool_and(F.col("piece").isNotNull()) & (F.count_distinct("n") == F.count(F.lit(1))) & (F.count_if("last") == 1)
    whole = whole & (F.max("n") == F.count(F.lit(1)) - 1) & (F.max(F.when(F.col("last"), F.col("n"))) == F.max("n"))
    out = rows.groupBy("id").agg(F.when(whole & (F.min("total") == F.max("total")), content).alias("content"), F.max("total").alias("total"))
    good = F.coalesce(F.octet_length("content") == F.col("total"), F.lit(False))
    return out.where(good).select("id", "content"), out.where(~good).select("id", F.lit("AUTHENTICATION_FAILED").alias("error"))


def vault_selfcheck(values: DataFrame, sealed: DataFrame, key: bytes) -> DataFrame:
    """(total, matched): how many originals there are, and how many open to themselves."""
    good = vault_open(sealed, key)[0].withColumnRenamed("content", "again")
    rows = values.join(good, ["id", "part"], "left")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("content") == F.col("again")).alias("matched"))
