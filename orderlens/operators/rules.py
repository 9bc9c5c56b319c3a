"""Rules mined in a train window and confirmed in a later validation window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import infer_size
from ..plans.scale import over_distinct
from ..sources.orders import TRAIN_BEFORE, VALIDATION_BEFORE, window_tag

# Fields whose rules need full purity in the train window.
CRITICAL_FIELDS = ["body_material", "seat_material", "closure_material", "pressure",
                   "standard_certification", "size"]
RULE_CONFIDENCE = 0.99


def rule_rows(rows: DataFrame, form: str, train_before: str = TRAIN_BEFORE,
              holdout_from: str = VALIDATION_BEFORE) -> DataFrame:
    """Dated rows with a form, a description and a standard specification, tagged by window.

    The conditions are counted, not filtered: a filter would be pushed below the parse of codes and
    texts and run it once more for every row.
    """
    good = ((F.col(form) != "") & (F.col("description") != "")
            & F.col("parsed_spec").isNotNull() & F.col("date").isNotNull())
    return (rows.select(F.col(form).alias("form"), "raw_description",
                        F.col("parsed_spec.prefix").alias("spec_prefix"),
                        F.col("parsed_spec.size").alias("spec_size"), "spec",
                        window_tag(F.col("date"), train_before, holdout_from).alias("window"),
                        good.alias("good"))
            .groupBy("form", "raw_description", "spec_prefix", "spec_size", "spec", "window")
            .agg(F.count_if("good").alias("n")).filter("n > 0"))


def prefix_purity(tagged: DataFrame) -> DataFrame:
    """Per form and window: dominant prefix, support and purity."""
    counts = tagged.groupBy("form", "window", "spec_prefix").agg(F.sum("n").alias("n"))
    return counts.groupBy("form", "window").agg(
        F.min_by("spec_prefix", F.struct(-F.col("n"), F.col("spec_prefix"))).alias("prefix"),
        F.sum("n").alias("support"), F.max("n").alias("top")).select(
        "form", "window", "prefix", "support", (F.col("top") / F.col("support")).alias("purity"))


def _window_pick(window: str, value: str) -> Column:
    return F.max(F.when(F.col("window") == window, F.col(value)))


def prefix_gate(purity: DataFrame, min_train: int = 20, min_validation: int = 5) -> DataFrame:
    """Forms whose prefix is pure and supported in both windows, and the same in both."""
    both = purity.groupBy("form").agg(*[
        _window_pick(w, v).alias(f"{w}_{v}")
        for w in ("train", "validation") for v in ("prefix", "support", "purity")])
    return both.filter(
        (F.col("train_support") >= min_train) & (F.col("train_purity") == 1.0)
        & (F.col("validation_support") >= min_validation) & (F.col("validation_purity") == 1.0)
        & (F.col("train_prefix") == F.col("validation_prefix"))).select(
        "form", F.col("train_prefix").alias("prefix"), "train_support", "validation_support")


def _sized(tagged: DataFrame) -> DataFrame:
    return over_distinct(tagged, ["raw_description"], lambda d: d.select(
        "raw_description", infer_size(F.col("raw_description")).alias("inferred")))


def prefix_rules(tagged: DataFrame, min_train: int = 20, min_validation: int = 5,
                 literal_spec: bool = False) -> DataFrame:
    """Prefix rules that also rebuild every specification with an inferable size.

    literal_spec compares with the specification as written (form-code rules) instead of its
    parsed prefix and size (variety rules).
    """
    actual = F.col("spec") if literal_spec else F.concat("spec_prefix", "spec_size")
    gated = prefix_gate(prefix_purity(tagged), min_train, min_validation)
    sized = _sized(tagged.join(gated, "form"))
    has_size = F.col("inferred").isNotNull()
    right = has_size & (F.concat("prefix", "inferred.size") == actual)

    def total(window: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when((F.col("window") == window) & condition, F.col("n"))),
                          F.lit(0))

    key = ["form", "prefix", "train_support", "validation_support"]
    combined = sized.groupBy(*key).agg(*[
        total(w, c).alias(f"{w}_{name}") for w in ("train", "validation")
        for name, c in (("sized", has_size), ("right", right))])
    return combined.filter(
        (F.col("train_sized") >= min_train) & (F.col("train_sized") == F.col("train_right"))
        & (F.col("validation_sized") >= min_validation)
        & (F.col("validation_sized") == F.col("validation_right"))).select(
        *key, F.col("train_sized").alias("train_combined_support"),
        F.col("validation_sized").alias("validation_combined_support"))


def rule_holdout(tagged: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: coverage and accuracy of the rules on the holdout window."""
    holdout = tagged.filter(F.col("window") == "holdout")
    joined = _sized(holdout.join(rules.select("form", "prefix"), "form", "left"))
    ruled = F.col("prefix").isNotNull()
    sized = ruled & F.col("inferred").isNotNull()
    right_prefix = ruled & (F.col("prefix") == F.col("spec_prefix"))
    right = sized & (F.concat("prefix", "inferred.size") == F.concat("spec_prefix", "spec_size"))

    def total(condition: Column | None = None) -> Column:
        n = F.col("n") if condition is None else F.when(condition, F.col("n"))
        return F.coalesce(F.sum(n), F.lit(0))

    counts = joined.agg(
        total().alias("holdout_rows"), total(ruled).alias("prefix_covered"),
        total(right_prefix).alias("prefix_correct"), total(sized).alias("combined_covered"),
        total(right).alias("combined_correct"))
    return counts.withColumns({
        "prefix_coverage": ratio("prefix_covered", "holdout_rows"),
        "prefix_accuracy": ratio("prefix_correct", "prefix_covered"),
        "combined_coverage": ratio("combined_covered", "holdout_rows"),
        "combined_accuracy": ratio("combined_correct", "combined_covered")})


def ratio(part: str, whole: str) -> Column:
    """Rounded share, 0 without a whole."""
    return F.coalesce(F.bround(F.try_divide(F.col(part), F.col(whole)), 4), F.lit(0.0))


def window_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("window").agg(F.sum("n").alias("rows"))


def counts_by_window(rows: DataFrame, keys: list[str], train_until: str,
                     validation_until: str) -> DataFrame:
    """Rows per key and window, n, dated by the last day of the window.

    mature_attribute_rules reads of a date its window only; counts per day would be nearly as many
    as the rows. Rows without a date or behind both windows are in none.
    """
    train, validation = F.lit(train_until).cast("date"), F.lit(validation_until).cast("date")
    last = F.when(F.col("date") <= train, train).when(F.col("date") <= validation, validation)
    return (rows.select(*keys, last.alias("date")).filter(F.col("date").isNotNull())
            .groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n")))


def mature_attribute_rules(designed: DataFrame, train_until: str, validation_until: str,
                           min_train: int = 20, min_validation: int = 5) -> DataFrame:
    """Attribute values that are stable over time per variety and per variety and form.

    ``designed`` holds by1, form_code, date, n and attributes (map of evidence structs). Rows with
    a form count for (by1, form) and for (by1, blank).
    """
    window = (F.when(F.col("date") <= F.lit(train_until).cast("date"), "train")
              .when(F.col("date") <= F.lit(validation_until).cast("date"), "validation"))
    tagged = designed.withColumns({"window": window, "by1": F.upper(F.trim("by1")),
                                   "form_code": F.upper(F.trim("form_code"))})
    tagged = tagged.filter(F.col("window").isNotNull() & (F.col("by1") != ""))
    items = (tagged.select("by1", "form_code", "window", "n",
                           F.explode(F.map_entries("attributes")).alias("item"))
             .select("by1", "form_code", "window", "n", F.col("item.key").alias("field"),
                     F.trim(F.col("item.value.value")).alias("value"))
             .filter(F.coalesce(F.col("value"), F.lit("")) != ""))
    fine = items.groupBy("by1", "form_code", "field", "window", "value").agg(F.sum("n").alias("n"))
    broad = fine.groupBy("by1", "field", "window", "value").agg(F.sum("n").alias("n")).select(
        "by1", F.lit("").alias("form_code"), "field", "window", "value", "n")
    counts = fine.filter(F.col("form_code") != "").unionByName(broad)
    key = ["by1", "form_code", "field"]
    per_window = counts.groupBy(*key, "window").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"),
        F.sum("n").alias("support"), (F.max("n") / F.sum("n")).alias("purity"))
    both = per_window.groupBy(*key).agg(*[
        _window_pick(w, v).alias(f"{w}_{v}")
        for w in ("train", "validation") for v in ("value", "support", "purity")])
    needed = F.when(F.col("field").isin(CRITICAL_FIELDS), 1.0).otherwise(0.99)
    return both.filter(
        (F.col("train_support") >= min_train) & (F.col("validation_support") >= min_validation)
        & (F.col("train_value") == F.col("validation_value"))
        & (F.col("train_purity") >= needed) & (F.col("validation_purity") == 1.0)).select(
        *key, F.col("train_value").alias("value"), F.lit(RULE_CONFIDENCE).alias("confidence"),
        "train_support", "validation_support", F.bround("train_purity", 6).alias("train_purity"),
        F.bround("validation_purity", 6).alias("validation_purity"), F.lit(True).alias("active"))
