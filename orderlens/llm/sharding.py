"""Rendezvous sharding of description rows over weighted shards, in DataFrame functions only.

Every shard draws a number from the row's key and its own label, and the highest draw takes the
row. Draws of different shards do not depend on each other, so a shard that is added takes rows
into itself only, a removed one gives up its own, and all else stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import written

BUCKET_BITS = 12


def _hash(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def _key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def draw(key: Column, shard: int, weight: float) -> Column:
    """Draw of a shard for a key: weight / -ln(u), u uniform in (0, 1) by the md5 of both.

    The highest of such draws falls on a shard with probability weight / sum of weights.
    """
    u = (_hash(F.concat(key, F.lit(f"#{shard}")), 13) + F.lit(0.5)) / F.lit(2.0 ** 52)
    return F.lit(float(weight)) / -F.log(u)


def with_shard(rows: DataFrame, weights: Sequence[float], key: str = "row_id",
               added: float = 1.0) -> DataFrame:
    """The rows with shard and grown_shard, which replace columns of these names.

    weights: one positive number a shard. grown_shard is the shard with one more of weight added.
    Both follow from the key and the weights alone, without a shuffle; equal draws go to the lower
    shard; a null key counts as the empty text, so such rows share a shard.
    """
    if not weights or min(*weights, added) <= 0:
        raise ValueError("shards need positive weights")
    own = _key(key)
    best = F.array_max(F.array(*[F.struct(draw(own, i, w).alias("draw"), F.lit(-i).alias("at"))
                                 for i, w in enumerate(weights)]))
    n = len(weights)
    shard = (-best["at"]).cast("int")
    grown = F.when(draw(own, n, added) > best["draw"], F.lit(n)).otherwise(shard)
    return rows.withColumns({"shard": shard, "grown_shard": grown})


def shard_places(rows: DataFrame, weights: Sequence[float], key: str = "row_id",
                 text: str = "description", added: float = 1.0) -> DataFrame:
    """Place of every row: key, size, text_crc32, shard, slot and grown_shard.

    size is the UTF-8 bytes of the text (null: none) plus 1, text_crc32 the unsigned CRC of these
    bytes. Slots of a shard run from 0 without gaps, in the order of a hash of the key, then size
    and CRC; rows equal in all of these take any of their slots. Other columns of the rows are
    left out: join on the key or call with_shard. Null keys, repeated rows, empty texts and no rows
    at all need no special care.

    Texts are read once and never shuffled. Rows are counted in cells of equal hash, size, CRC and
    input partition; a cell's first slot is a running sum inside one of 4,096 ranges of the hash
    plus what lies in the ranges before. Thus rows of one key that hold a large share of the input
    are spread by the partitions they came from.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    own = with_shard(rows.select(F.col(key), (F.octet_length(raw).cast("long") + 1).alias("size"),
                                 F.crc32(raw).alias("text_crc32")), weights, key, added)
    narrow = written(own.select(
        F.col(key).alias("key"), "size", "text_crc32", "shard", "grown_shard",
        _hash(_key(key), 15).alias("hash"), F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("seq")), "shard-rows")
    cell = ["shard", "hash", "size", "text_crc32", "part"]
    bucket = F.shiftright("hash", 60 - BUCKET_BITS).alias("bucket")
    cells = narrow.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).select("*", bucket)
    inside = (Window.partitionBy("shard", "bucket").orderBy(*cell[1:])
              .rowsBetween(Window.unboundedPreceding, -1))
    earlier = (Window.partitionBy("shard").orderBy("bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    none = F.lit(0).cast("long")
    starts = (narrow.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), none).alias("base")))
    first = (cells.withColumn("before", F.coalesce(F.sum("n").over(inside), none))
             .join(starts, ["shard", "bucket"])
             .select(*cell, (F.col("base") + F.col("before")).alias("first")))
    turn = F.row_number().over(Window.partitionBy(*cell).orderBy("seq")) - 1
    return (narrow.withColumn("turn", turn).join(first, cell)
            .select(F.col("key").alias(key), "size", "text_crc32", "shard",
                    (F.col("first") + F.col("turn")).alias("slot"), "grown_shard"))


def write_shards(rows: DataFrame, path: str, weights: Sequence[float], key: str = "row_id") -> None:
    """Whole rows as Parquet in one folder a shard, each task writing what it read."""
    with_shard(rows, weights, key).drop("grown_shard").write.partitionBy("shard").parquet(path)
