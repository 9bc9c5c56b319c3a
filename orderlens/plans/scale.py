"""Plan helpers for large inputs: distinct rewrites, salted lookups, lineage cuts, size checks."""

from __future__ import annotations

import math
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Joins carry no broadcast hints: adaptive execution broadcasts a side once its measured size is
# below the configured threshold.
SALTS = 8
# Spark's switch that removes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Bytes of files whose shuffles may lie on the disks at one time; larger inputs go slice by slice.
SLICE_BYTES = 256 << 20
# Every slice reads its inputs whole, and room on the disks grows with the input: more save little.
MOST_SLICES = 12
# Spark's estimate of a table that it knows nothing of is no size.
UNKNOWN_BYTES = 1 << 60
# Written of large tables, where disk counts more than speed. Small ones stay as they are: their
# file size decides what Spark broadcasts.
DENSE = {"compression": "zstd"}


def cut_lineage(df: DataFrame, by: list[str] | None = None,
                most: int = MOST_SLICES) -> DataFrame:
    """Materialise in the cluster's shared folder, so lost executors cost no recompute.

    The rows are written as Parquet and read again: a checkpoint holds whole rows uncompressed, is
    read whole for every column, and keeps the size estimates of its plan, which multiply from join
    to join. Shuffle files of the write go with it. by: see in_slices.
    """
    return cut_parts([df] if by is None else slices(df, by, min(most, slices_of(df))))


def cut_parts(parts: list[DataFrame]) -> DataFrame:
    """Frames of one schema materialised one after the other, as one."""
    spark = parts[0].sparkSession
    path = _cut_path(spark)
    write_parts(parts, path)
    return spark.read.schema(parts[0].schema).parquet(path)


def _cut_path(spark: SparkSession) -> str:
    folder = spark.sparkContext.getCheckpointDir() or shared_folder(spark)
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    for scope in getattr(_open, "scopes", []):
        scope.append(path)
    return path


_open = threading.local()


@contextmanager
def passing_cuts(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside go at the end: for work whose results are written before."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for name in scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of every execution inside go at its end: what is needed later is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def write_parts(parts: list[DataFrame], path: str) -> None:
    """Frames of one schema written to one folder, one after the other."""
    for part in parts:
        with shuffles_removed(part.sparkSession):
            part.write.mode("append").options(**density(len(parts))).parquet(path)


def density(n: int) -> dict:
    """Options of the files of a table that is written in n slices."""
    return DENSE if n > 1 else {}


def slices_of(df: DataFrame) -> int:
    """Number of slices for the bytes that a frame reads; 1 for a frame that moves no rows."""
    plan = df._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    if "Aggregate" not in text and "Join" not in text:
        return 1
    leaves = plan.collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return slices_for(sum(x for x in sizes if x < UNKNOWN_BYTES))


def slices_for(size: int) -> int:
    return min(MOST_SLICES, max(1, math.ceil(size / SLICE_BYTES)))


def slices(df: DataFrame, columns: list[str], n: int) -> list[DataFrame]:
    """The rows of a frame in n frames by the hash of some columns."""
    if n == 1:
        return [df]
    return [df.filter(F.pmod(F.xxhash64(*columns), F.lit(n)) == i) for i in range(n)]


def in_slices(df: DataFrame, by: list[str], most: int = MOST_SLICES) -> DataFrame:
    """The same rows; of a large input materialised slice by slice of the hash of some columns.

    Every slice is a whole execution over its share of the keys, whose shuffle files go before the
    next one begins, so the disks hold the shuffles of one slice and never of the whole input. The
    columns have to come unchanged from the inputs (grouping and join keys), or nothing is saved. A
    small input stays lazy.
    """
    return cut_lineage(df, by, most) if slices_of(df) > 1 else df


def shared_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir, which driver and executors must share.

    It has to be set on a cluster; only a local master may go without, and gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="orderlens-")


def over_distinct(df: DataFrame, keys: list[str], enrich, row_id: str | None = None) -> DataFrame:
    """Run enrich once per distinct key and join the result back to every row.

    With a row_id the join is salted, for raw rows where one key may hold a large share of all
    rows. Without one the input is already aggregated and adaptive skew splitting is enough.
    """
    enriched = enrich(df.select(*keys).distinct())
    if row_id is None:
        return df.join(enriched, keys, "left")
    return salted_lookup(df, enriched, keys, row_id)


def salted_lookup(big: DataFrame, small: DataFrame, keys: list[str], row_id: str,
                  how: str = "left", salts: int = SALTS) -> DataFrame:
    """Equi join in which the rows of one hot key spread over several tasks.

    ``small`` holds one row per key. Rows of ``big`` get a salt from row_id, rows of ``small`` are
    repeated once per salt.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def dealt(df: DataFrame) -> DataFrame:
    """The frame as a side of joins that is never broadcast.

    Spark knows tables by the size of their files and of shuffled blocks. Lists and texts that
    repeat take many times that in the memory of the driver.
    """
    return df.hint("merge")


def ordered_rank(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """1-based position of each row among the rows of its key, in a given order.

    Rows are range-partitioned by key and order, numbered inside their partition and shifted by
    the counts of earlier partitions, so a hot key never meets in one task. The numbered rows are
    materialised, because the numbers must not change if a task runs again.
    """
    from pyspark.sql import Window
    numbered = cut_lineage(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_seq", 33)))
    starts = numbered.groupBy(*keys, "_part").agg(
        F.min("_seq").alias("_start"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    shift = starts.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (numbered.join(shift, [*keys, "_part"])
            .withColumn(name, F.col("_seq") - F.col("_start") + 1 + F.col("_shift"))
            .drop("_seq", "_part", "_start", "_shift"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int,
          name: str = "rank") -> DataFrame:
    """First k rows per key; the limit also runs before the shuffle, so hot keys stay small."""
    from pyspark.sql import Window
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
