"""URL filters: host and path rules, then a listed-URL test behind a blocked Bloom filter.

Native throughout: the filter is a table of 512-bit blocks built with ``bit_or``, the
probe is an equi-join on the block number plus eight bit tests, and only possible hits
go on to the exact hash join, which removes the false positives.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no
rule and is never listed (verdict ``allow``). Repeated rows stay repeated. An empty
list blocks nothing; an empty table gives an empty result. A very long url is one value. Columns of the pages other than the id and the url are ignored,
so clashing names do no harm; extra columns of the list are ignored too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from desense.llm.common import LOWER, UPPER, written

BLOCK_BYTES = 72
#: A larger Bloom table is joined by shuffle on the block number instead of broadcast.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path and query of a url; all empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return tuple(F.coalesce(x, F.lit("")) for x in (host, path, query))


def canonical_url(host: Column, path: Column, query: Column) -> Column:
    """Host without ``www.``, path without closing slashes, query without tracking
    parameters and in sorted order; scheme and fragment don't count."""
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)=")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    kept_url = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""), tail)
    return F.when(host != "", kept_url)


def rule_for(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; of equal ones, a blocking one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.verdict == "block")):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _lanes(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit("lanes"))
    picked = [F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int") for i in range(8)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), bit) for bit in picked]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(n_blocks))


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """One row of eight 64-bit words for each block that has a key."""
    marked = keys.select(_block(F.col("canonical"), n_blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_lanes(F.col("canonical")))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def url_filter(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[UrlRule],
    id_column: str = "page_id",
    url_column: str = "url",
    bits_per_key: int = 16,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Judge every page: (id, host, path, rule, verdict, listed).

    ``listed`` has a ``url`` column. ``bits_per_key`` sets the filter's size, and with it
    the share of false hits (about 0.1 % at 16) that the exact join has to remove.
    """
    host, path, query = url_parts(F.col(url_column))
    parts = pages.select(F.col(id_column), host.alias("host"), path.alias("path"), query.alias("_query"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parts = parts.select(
        id_column, "host", "path", name.alias("rule"), verdict.alias("_verdict"),
        canonical_url(F.col("host"), F.col("path"), F.col("_query")).alias("canonical"),
    )
    lh, lp, lq = url_parts(F.col("url"))
    keys = (
        listed.select(lh.alias("h"), lp.alias("p"), lq.alias("q"))
        .select(canonical_url(F.col("h"), F.col("p"), F.col("q")).alias("canonical"))
        .where("canonical is not null")
        .distinct()
    )
    keys = written(keys)
    n_blocks = max(1, -(-keys.count() * bits_per_key // 512))
    # written, so that Spark can split what a hot url makes large in the joins
    blocks = written(bloom_blocks(keys, n_blocks))
    if n_blocks * BLOCK_BYTES <= broadcast_bytes:
        blocks = F.broadcast(blocks)
    unlisted = parts.where("canonical is null")  # many rows may have no host: they need no probe
    probed = parts.where("canonical is not null").withColumn("block", _block(F.col("canonical"), n_blocks)).join(blocks, "block", "left")
    inside = F.lit(True)
    for i, mask in enumerate(_lanes(F.col("canonical"))):
        inside = inside & (F.col(f"w{i}").bitwiseAND(mask) != 0)
    probed = probed.withColumn("possible", F.coalesce(inside, F.lit(False)))
    out = [id_column, "host", "path", "rule", "_verdict"]
    hits = probed.where("possible").select(*out, "canonical").join(keys.withColumn("listed", F.lit(True)), "canonical", "left")
    judged = hits.select(*out, F.coalesce("listed", F.lit(False)).alias("listed"))
    for rest in (probed.where("not possible"), unlisted):
        judged = judged.unionByName(rest.select(*out, F.lit(False).alias("listed")))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select(id_column, "host", "path", "rule", F.coalesce("_verdict", method).alias("verdict"), "listed")
