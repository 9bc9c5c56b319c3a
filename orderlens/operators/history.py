"""Evidence tables: description records, counters, key-level distributions, source profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.standardize import with_segments
from ..sources.orders import usable

RECORD_KEY = ["description", "form_code", "by1", "spec"]
COUNTERS = {"customers": "customer_key", "materials": "material", "surfaces": "surface",
            "business_prefixes": "business_prefix"}


def _first(column: str) -> Column:
    """Value of the earliest row by date, then row id; undated rows come last."""
    order = F.struct(F.col("date").isNull(), F.col("date"), F.col("row_id"), F.col(column))
    return F.min(order)[column]


def recommendation_records(rows: DataFrame) -> DataFrame:
    """One row per (description, form, by1, spec) with support, first example and date range."""
    grouped = usable(rows).groupBy(*RECORD_KEY).agg(
        F.count(F.lit(1)).alias("count"), _first("raw_description").alias("example"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.first("parsed_spec").alias("parsed_spec"))
    records = grouped.withColumns({
        "spec_prefix": F.coalesce(F.col("parsed_spec.prefix"), F.lit("")),
        "spec_size": F.coalesce(F.col("parsed_spec.size"), F.lit("")),
    }).drop("parsed_spec")
    return with_segments(records, "example").select(
        *records.columns, F.col("semantic_text").alias("semantic_description"))


def record_counters(rows: DataFrame) -> DataFrame:
    """Long counters per record: (record key, counter, value, count); blank values are skipped.

    Long form keeps a record with millions of customers spread over many rows.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("counter"), F.col(column).alias("value"))
                      for name, column in COUNTERS.items()])
    return (usable(rows).withColumn("pair", F.explode(pairs)).filter(F.col("pair.value") != "")
            .groupBy(*RECORD_KEY, F.col("pair.counter").alias("counter"),
                     F.col("pair.value").alias("value"))
            .agg(F.count(F.lit(1)).alias("count")))


def legacy_rows(rows: DataFrame) -> DataFrame:
    """Rows of the specification index: the variety is the form; customers are the distinct
    short and document names."""
    names = F.array_distinct(F.filter(F.array("customer_key", "document_key"), lambda c: c != ""))
    return usable(rows).select("row_id", "date", "raw_description", "description",
                               F.col("by1").alias("form_code"), "spec", names.alias("customers"))


def spec_records(rows: DataFrame) -> DataFrame:
    """One row per (description, form, spec) with support and first example."""
    return legacy_rows(rows).groupBy("description", "form_code", "spec").agg(
        F.count(F.lit(1)).alias("count"), _first("raw_description").alias("example"))


def spec_record_customers(rows: DataFrame) -> DataFrame:
    """Long customer counters of the specification records."""
    return (legacy_rows(rows).withColumn("customer_key", F.explode("customers"))
            .groupBy("description", "form_code", "spec", "customer_key")
            .agg(F.count(F.lit(1)).alias("count")))


LEVELS = {"description_form": (True, False), "description": (False, False),
          "description_form_customer": (True, True), "description_customer": (False, True)}


def evidence_levels(rows: DataFrame, value: str, form: str = "form_code") -> DataFrame:
    """Value counts at four key levels: description with form and customer, with form, with
    customer, and alone. Absent key parts are blank."""
    base = usable(rows).groupBy("description", F.col(form).alias("form_code"), "customer_key",
                                F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return _at_levels(base, list(LEVELS))


def legacy_evidence_levels(rows: DataFrame) -> DataFrame:
    """The same levels for the specification index, where one row may count for two customers."""
    rows = legacy_rows(rows)
    value = F.col("spec").alias("value")
    base = rows.groupBy("description", "form_code", value).agg(F.count(F.lit(1)).alias("n"))
    named = (rows.withColumn("customer_key", F.explode("customers"))
             .groupBy("description", "form_code", "customer_key", value)
             .agg(F.count(F.lit(1)).alias("n")))
    plain = [level for level, (_, customer) in LEVELS.items() if not customer]
    return _at_levels(base.withColumn("customer_key", F.lit("")), plain).unionByName(
        _at_levels(named, [level for level in LEVELS if level not in plain]))


def _at_levels(base: DataFrame, levels: list[str]) -> DataFrame:
    """Roll counts up to several levels in one pass over them."""
    def level_key(level: str) -> Column:
        form, customer = LEVELS[level]
        key = F.struct(F.lit(level).alias("level"),
                       (F.col("form_code") if form else F.lit("")).alias("form_code"),
                       (F.col("customer_key") if customer else F.lit("")).alias("customer_key"))
        return F.when(F.col("customer_key") != "", key) if customer else key

    keyed = base.select("description", "value", "n", F.explode(F.array_compact(F.array(
        *[level_key(level) for level in levels]))).alias("k"))
    return keyed.groupBy("k.level", "description", "k.form_code", "k.customer_key", "value").agg(
        F.sum("n").alias("n"))


def source_profile(rows: DataFrame, exact: bool = True) -> DataFrame:
    """One row: input rows, indexed rows, distinct keys and date range.

    exact=False counts distinct keys by sketch, for inputs too large for exact distinct counts.
    """
    good = (F.col("description") != "") & (F.col("by1") != "") & (F.col("spec") != "")
    distinct = F.count_distinct if exact else F.approx_count_distinct

    def distinct_of(column: str) -> Column:
        return distinct(F.when(good, F.col(column)))

    return rows.agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(good).alias("indexed_rows"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        distinct_of("description").alias("descriptions"), distinct_of("by1").alias("by1s"),
        distinct_of("spec").alias("specifications"), distinct_of("form_code").alias("form_codes"))
