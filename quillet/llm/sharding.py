"""Rendezvous sharding over weighted shards, with DataFrame functions only.

Each row's key, as text, and each shard give a hash in (0, 1); the shard with the largest -weight / ln(hash) takes the
row (highest random weight). A new shard therefore takes rows only into itself, and every other row stays.
Slots are gapless places in a shard, found without one task per shard: rows are staged with a row number, ranked
inside (shard, bucket) groups of about GROUP_ROWS rows, buckets being a hash of that number, so that not even one row
repeated many times fills a group; and a table of group sizes gives each group's first slot.

Defined results: a null text has no bytes and counts as empty; a null key is a key of its own; rows with
equal keys share a shard and get different slots; an empty table gives an empty table; only the key and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillet.llm.common import staged

#: Bytes that a record takes beside its text.
RECORD_BYTES = 16
_TWO_53 = float(1 << 53)
#: Rows that are ranked in one group, on average.
GROUP_ROWS = 200_000


def _score(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u) for u in (0, 1) from 53 bits of a hash of key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(shard)), 11)
    return F.lit(-float(weight)) / F.log((bits.cast("double") + 0.5) / _TWO_53)


def _best(key: Column, weights: Sequence[float]) -> Column:
    """Score and minus the number of the best shard."""
    each = [F.struct(_score(key, s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]
    return F.greatest(*each) if len(each) > 1 else each[0]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, that takes the key; the lower shard takes an equal score."""
    return -_best(key, weights)["shard"]


def assign(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: Sequence[float] = (1.0,) * 40,
    grown_weight: float = 1.0,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """id, size, text_crc32, law, shard, slot and the shard with one shard more (grown_shard)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    n = len(weights)
    best = _best(key, weights)
    rows = staged(
        df.select(
            key,
            (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            best.alias("__best"),
            _score(key, n, grown_weight).alias("__new"),
        )
        .select(
            id_col,
            "size",
            "text_crc32",
            (-F.col("__best.shard")).alias("shard"),
            F.when(F.col("__new") > F.col("__best.score"), n).otherwise(-F.col("__best.shard")).alias("grown_shard"),
            F.monotonically_increasing_id().alias("__rid"),
        ),
        "shards",
    )
    buckets = -(-rows.count() // (group_rows * n)) or 1
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__rid"), F.lit(buckets)))
    sizes = rows.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    in_group = W.partitionBy("shard", "__bucket").orderBy("__rid")
    return (
        rows.withColumn("__rank", F.row_number().over(in_group))
        .join(first, ["shard", "__bucket"])
        .select(
            id_col,
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            F.col("shard").cast("int"),
            (F.col("__first") + F.col("__rank") - 1).cast("long").alias("slot"),
            F.col("grown_shard").cast("int"),
        )
    )
