"""Best-fit packing of token runs into sequences of several permitted lengths.

Runs longer than the greatest length are cut into pieces of that length and a rest; the
pieces are shared out evenly among shards by a hash of the row, so that each shard is a
bounded number of pieces, whatever their ids, and holds a like mix of lengths; only ids
and lengths are moved. Within
a shard, longest first, a piece goes to the open bin that it leaves least room in. Where
none fits, a bin is opened with the length whose cost for each token it can still hold
is least, given what is left to pack. Finally each bin is downsized to the smallest
length that holds its contents. A shard more costs at most about one part-filled bin.

Cost of a sequence of length n: ``FIXED + n + n * n / QUADRATIC``, i.e. overhead, linear
work and attention. It is a parameter.

Defined cases: rows without tokens (null or non-positive length) and null ids get no
bin, and have a row with piece 0, no bin and no place; equal lengths go by id, then by
piece; repeated rows are packed each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from desense.llm.common import written

LENGTHS = (512, 1024, 2048, 4096, 8192)
FIXED, QUADRATIC = 128, 32_768
SHARD_PIECES = 20_000

PACKED = "doc_id long, n_tokens long, piece int, piece_tokens long, shard int, bin int, bin_length int, bin_tokens long, place long"


def sequence_cost(length: int) -> float:
    return FIXED + length + length * length / QUADRATIC


def best_fit(pieces: list[int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece (pieces longest first), and length and contents of each bin.

    Open bins are kept by room left; a bit set of the rooms that occur finds the least
    room that is enough.
    """
    left, bin_of, opened, held = sum(pieces), [], [], []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for size in pieces:
        enough = rooms >> size
        if enough:
            room = size + (enough & -enough).bit_length() - 1
            which = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room = min((n for n in lengths if n >= size), key=lambda n: (cost(n) / min(n, left), n))
            which = len(opened)
            opened.append(room)
            held.append(0)
        bin_of.append(which)
        held[which] += size
        left -= size
        if room > size:
            by_room.setdefault(room - size, []).append(which)
            rooms |= 1 << (room - size)
    return bin_of, [min(n for n in lengths if n >= h) for h in held], held


def pack(runs: DataFrame, lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = sequence_cost, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack rows (doc_id, n_tokens): one row for each piece, with its bin and place."""
    lengths = tuple(sorted(lengths))
    most = lengths[-1]
    n = F.col("n_tokens")
    # rows get numbers, so that rows of one id go to any shard; they are written, so fixed
    rows = written(runs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(n.cast("long"), F.lit(0)).alias("n_tokens"), F.monotonically_increasing_id().alias("_row")))
    has = (n > 0) & F.col("doc_id").isNotNull()
    last = F.ceil(n / most).cast("int") - 1
    pieces = rows.where(has).select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"), last.alias("_last"))
    size = F.when(F.col("piece") < F.col("_last"), most).otherwise(n - F.col("_last").cast("long") * most)
    total = rows.where(has).agg(F.sum(F.ceil(n / most)).alias("n")).first()["n"] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    pieces = pieces.select("doc_id", "n_tokens", "piece", size.cast("long").alias("piece_tokens"), F.pmod(F.xxhash64("_row", "piece"), F.lit(shards)).cast("int").alias("shard"))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["piece_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bin_of, sizes, held = best_fit(shard["piece_tokens"].tolist(), lengths, cost)
        shard["bin"] = bin_of
        shard["bin_length"] = [sizes[b] for b in bin_of]
        shard["bin_tokens"] = [held[b] for b in bin_of]
        shard["place"] = shard.groupby("bin")["piece_tokens"].cumsum() - shard["piece_tokens"]
        return shard

    columns = [c.split()[0] for c in PACKED.split(", ")]
    packed = pieces.groupBy("shard").applyInPandas(lambda s: run(s)[columns], PACKED)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("shard", "int"), ("bin", "int"), ("bin_length", "int"), ("bin_tokens", "long"), ("place", "long"))]
    empty = rows.where(~F.coalesce(has, F.lit(False))).select("doc_id", "n_tokens", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("piece_tokens"), *none)
    return packed.unionByName(empty)
