"""Evidence index: the ranked values of every key level, one row per description and customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import cut_parts, dealt, slices, slices_of
from ..sources.orders import usable
from .history import legacy_rows

KEYS = ["description", "customer_key"]
STORED_VALUES = 100


def evidence_index(rows: DataFrame, value: str, form: str = "form_code",
                   buckets: int | None = None) -> DataFrame:
    """Ranked evidence of prepared order rows: description, customer_key, whole and forms.

    A blank customer_key stands for all customers of the description. whole ranks the values of
    all forms, forms those of each form: total (rows), candidates (distinct values) and the
    STORED_VALUES best values as (rank, value, n), by n, then value. So the four key levels of a
    description lie in two rows, and customers of a hot description are spread over many rows. A
    row's size follows code vocabularies, not orders.

    Counts are combined before they are dealt by key; all ranking then runs where the rows lie, and
    the result has the partitioning of a table of as many buckets.
    """
    return index_counts(usable(rows).select(
        "description", F.col(form).alias("form_code"), F.col(value).alias("value"),
        F.array("customer_key").alias("names"), F.lit(1).alias("n")), buckets)


def legacy_evidence_index(rows: DataFrame, buckets: int | None = None) -> DataFrame:
    """The same for the specification index, where a row counts for each of its customer names."""
    return index_counts(legacy_rows(rows).select(
        "description", "form_code", F.col("spec").alias("value"), F.col("customers").alias("names"),
        F.lit(1).alias("n")), buckets)


def index_counts(counts: DataFrame, buckets: int | None = None) -> DataFrame:
    """Evidence index of counts: description, form_code, value, names (customers) and n."""
    buckets = buckets or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = F.concat(F.array(F.lit("")), F.filter("names", lambda c: c != ""))
    fine = (counts.select("description", F.explode(named).alias("customer_key"), "form_code",
                          "value", "n")
            .groupBy(*KEYS, "form_code", "value").agg(F.sum("n").cast("long").alias("n")))
    dealt = fine.repartition(buckets, *KEYS)
    # No exchange from here on: every grouping holds the keys. A null form is all forms together.
    leveled = dealt.select(*KEYS, F.explode(F.array("form_code", F.lit(None).cast("string")))
                           .alias("form"), "value", "n").filter("form IS NULL OR form <> ''")
    valued = leveled.groupBy(*KEYS, "form", "value").agg(F.sum("n").alias("n"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))),
                   1, STORED_VALUES)
    ranked = F.transform(best, lambda x, i: F.struct(
        (i + 1).alias("rank"), x["value"].alias("value"), (-x["n"]).alias("n")))
    per_form = valued.groupBy(*KEYS, "form").agg(F.struct(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("candidates"),
        ranked.alias("ranked")).alias("e"))
    return per_form.groupBy(*KEYS).agg(
        F.max(F.when(F.col("form").isNull(), F.col("e"))).alias("whole"),
        F.map_from_entries(F.collect_list(F.when(F.col("form").isNotNull(), F.struct("form", "e"))))
        .alias("forms"))


def exact_hits(keys: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Strongest exact level of each request key, once for its customer and once for all.

    keys: query, description, form_code, customer_key. A key meets two rows of the index at most;
    of these only the keys move when the index is a stored table of buckets.
    An index that is not stored yet is ranked and met slice by slice of the descriptions, if large.
    """
    none = F.lit("")
    asked = keys.withColumn("asked_customer", F.explode(F.array_compact(F.array(
        none, F.when(F.col("customer_key") != "", F.col("customer_key"))))))
    stored = index.select(F.col("description").alias("e_description"),
                          F.col("customer_key").alias("e_customer"), "whole", "forms")
    of_form = F.when(F.col("form_code") != "", F.try_element_at("forms", F.col("form_code")))

    def hits(asked: DataFrame, stored: DataFrame) -> DataFrame:
        met = dealt(asked).join(stored, (F.col("description") == F.col("e_description"))
                         & (F.col("asked_customer") == F.col("e_customer")))
        met = met.withColumns({"of_form": of_form, "hit": F.coalesce(of_form, F.col("whole"))})
        return met.select(*keys.columns, _level().alias("level"), "hit.total", "hit.candidates",
                          F.slice("hit.ranked", 1, k).alias("ranked"))

    n = slices_of(index)
    if n == 1:
        return hits(asked, stored)
    return cut_parts([hits(a, b) for a, b in zip(
        slices(asked, ["description"], n), slices(stored, ["e_description"], n), strict=True)])


def _level() -> Column:
    return F.concat(F.lit("description"),
                    F.when(F.col("of_form").isNotNull(), "_form").otherwise(""),
                    F.when(F.col("e_customer") != "", "_customer").otherwise(""))


def evidence_rows(index: DataFrame) -> DataFrame:
    """The index as long rows: level, description, form_code, customer_key, total, candidates,
    rank, value, n."""
    every = F.concat(
        F.array(F.struct(F.lit("").alias("form_code"), F.lit("").alias("part"),
                         F.col("whole").alias("e"))),
        F.transform(F.map_entries("forms"), lambda x: F.struct(
            x["key"].alias("form_code"), F.lit("_form").alias("part"), x["value"].alias("e"))))
    level = F.concat(F.lit("description"), F.col("l.part"),
                     F.when(F.col("customer_key") != "", "_customer").otherwise(""))
    return (index.select(*KEYS, F.explode(every).alias("l"))
            .select(level.alias("level"), "description", "l.form_code", "customer_key",
                    "l.e.total", "l.e.candidates", F.explode("l.e.ranked").alias("r"))
            .select("level", "description", "form_code", "customer_key", "total", "candidates",
                    "r.*"))
