"""Inputs of the checked queries, all derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.publish import read_lookup, write_lookup
from ..plans.scale import shared_folder, write_parts
from ..sources.orders import (VALIDATION_BEFORE, before, holdout_rows, load_orders, load_points,
                              order_history, order_slices, prepare_orders, read_table)


def prepared(spark: SparkSession, d: str) -> DataFrame:
    return prepare_orders(load_orders(order_history(spark, d)))


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Prepared rows, parsed once and materialised, for queries that read them several times."""
    return needed(spark, d)


def needed(spark: SparkSession, d: str, *columns: str, variants: bool = False) -> DataFrame:
    """Some columns of the prepared rows (all without names), written once, slice by slice of the
    orders, and read by column."""
    path = new_folder(spark, "prepared")
    write_parts([prepare_orders(load_orders(part)).select(*columns or ["*"])
                 for part in order_slices(spark, d, variants)], path)
    return spark.read.parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def as_lookup(index: DataFrame, keys: list[str]) -> DataFrame:
    """The index as a stored table of buckets."""
    path = new_folder(index.sparkSession, "lookup")
    write_lookup(index, path, keys)
    return read_lookup(index.sparkSession, path)


def history(spark: SparkSession, d: str) -> DataFrame:
    return past(prepared(spark, d))


def past(rows: DataFrame) -> DataFrame:
    return before(rows, VALIDATION_BEFORE)


def later(rows: DataFrame) -> DataFrame:
    return holdout_rows(rows, VALIDATION_BEFORE)


def texts(spark: SparkSession, d: str) -> DataFrame:
    return order_history(spark, d).select("description").distinct()


def requests(rows: DataFrame) -> DataFrame:
    """Holdout orders of prepared rows as requests without a customer."""
    return later(rows).select(F.col("row_id").alias("request_id"),
                                    F.col("raw_description").alias("query"),
                                    F.lit("").alias("customer"), "form_code")


def keys(rows: DataFrame, form: str = "form_code", customer: bool = False) -> DataFrame:
    """Distinct request keys of prepared rows."""
    return rows.select(F.col("raw_description").alias("query"), "description",
                       F.col(form).alias("form_code"),
                       (F.col("customer_key") if customer else F.lit("").alias("customer_key"))
                       ).distinct()


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").alias("vector"))


def points(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    return load_points(e.select(
        F.col("id").alias("point_id"), F.concat(F.lit("V"), "label").alias("by1"), "vector",
        (F.length("id") + F.col("label").cast("int")).alias("support"),
        F.concat(F.lit("text "), "id").alias("description"),
        F.concat(F.lit("Text "), "id").alias("example"),
        F.concat(F.lit("F"), F.right("id", F.lit(1))).alias("form_code"),
        F.concat(F.lit("D"), F.right("id", F.lit(1))).alias("spec")))
