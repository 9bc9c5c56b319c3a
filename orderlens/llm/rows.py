"""Description rows, the order of turns, labelled samples and the run-by-run reading of sorted Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scale import CLEANUP, shared_folder


def description_rows(documents: DataFrame, *more: str) -> DataFrame:
    """Documents as description rows: doc_id is the row_id, text the description."""
    return documents.select(F.col("doc_id").alias("row_id"), F.col("text").alias("description"),
                            *more)


def turn_order(turn: Column, role: Column, text: Column) -> list[Column]:
    """Order of a conversation's rows: turn with nulls first, then role and text by their first 32
    characters, then a digest of both in full."""
    return [turn.isNotNull().alias("dated"), F.coalesce(turn, F.lit(0)).alias("turn"),
            F.left(role, F.lit(32)).alias("role_head"), F.left(text, F.lit(32)).alias("text_head"),
            turn_digest(role, text).alias("digest")]


def turn_digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
                 .cast("binary"))


def labelled_sample(rows: DataFrame, labels: DataFrame, per_label: int, max_chars: int) -> DataFrame:
    """At most per_label rows of each label 0 and 1, the first ones by a hash of row_id.

    The sample fits a classifier only: its bounds are per_label rows of at most max_chars
    characters. labels: row_id, label; other labels and nulls are not sampled.
    """
    ids = None
    for value in (0, 1):
        part = (labels.filter((F.col("label") == value) & F.col("row_id").isNotNull())
                .groupBy("row_id").agg(F.max("label").cast("int").alias("label"))
                .orderBy(F.xxhash64("row_id"), "row_id").limit(per_label))
        ids = part if ids is None else ids.unionByName(part)
    return (rows.filter(F.col("row_id").isNotNull()
                        & (F.length(F.coalesce("description", F.lit(""))) <= max_chars))
            .join(ids, "row_id"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    folder = spark.sparkContext.getCheckpointDir() or shared_folder(spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again.

    Shuffle files of the write go with it: what is needed later is in the table.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Remove tables of written whose readers have all been written."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.shared_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """The name, longer by marks until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, of batches that arrive sorted by the keys.

    Only the run being read is held, so memory follows the largest run, not the partition.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        marks = list(zip(*columns, strict=True))
        start = 0
        for i, mark in enumerate(marks):
            if mark != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, mark
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most rows rows, to bound what is held beside them."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
