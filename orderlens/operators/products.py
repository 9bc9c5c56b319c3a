"""Products and their texts: prefix matches, batch import, appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import parent_id
from ..functions.standardize import with_segments
from ..functions.text import prefix_match_len, prefix_similarity, strip
from ..plans.scale import ordered_rank, over_distinct, top_k

PREFIX_MATCHES = 5


def prefix_index(existing: DataFrame, k: int = PREFIX_MATCHES) -> DataFrame:
    """First k + 1 codes, by code, of every (prefix, code length).

    Codes of one prefix and length score alike or better against any request, so no code outside
    these can be among the k best; the extra one replaces the request itself.
    """
    codes = existing.select("by1").distinct().filter(F.col("by1") != "")
    upper = F.upper("by1")
    exploded = codes.withColumn("length", F.length("by1")).withColumn("at", F.explode(
        F.sequence(F.lit(1), F.length(upper)))).withColumn("prefix", F.left(upper, F.col("at")))
    return top_k(exploded, ["prefix", "length"], [F.asc("by1")], k + 1).select(
        "prefix", "length", F.col("by1").alias("match"))


def rank_prefix_matches(new: DataFrame, existing: DataFrame, k: int = PREFIX_MATCHES) -> DataFrame:
    """The k most similar existing codes per new code by common prefix over the longer length.

    Both sides meet on prefixes, not on all pairs: see prefix_index.
    """
    codes = new.select("by1").distinct().filter(F.col("by1") != "")
    upper = F.upper("by1")
    probes = codes.withColumn("at", F.explode(F.sequence(F.lit(1), F.length(upper)))).select(
        "by1", F.left(upper, F.col("at")).alias("prefix"))
    met = probes.join(prefix_index(existing, k), "prefix").filter(
        F.col("match") != F.col("by1")).select("by1", "match").distinct()
    scored = met.withColumns({
        "score": prefix_similarity(F.col("by1"), F.col("match")),
        "prefix_match_len": prefix_match_len(F.col("by1"), F.col("match"))})
    return top_k(scored, ["by1"], [F.desc("score"), F.asc("match")], k)


def product_counts(texts: DataFrame) -> DataFrame:
    """Number of texts per product; texts: by1, position, text."""
    return texts.groupBy("by1").agg(F.count(F.lit(1)).alias("edesc_count"))


def batch_import(new: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Import new codes from their most referenced close relative.

    new: by1; texts: by1, position, text of the existing products. Returns (report, copied texts).
    """
    asked = new.select("by1").distinct()
    counts = product_counts(texts)
    present = asked.join(counts, "by1", "left_semi")
    missing = asked.join(counts, "by1", "left_anti")
    matches = rank_prefix_matches(missing, counts).join(
        counts.withColumnRenamed("by1", "match"), "match")
    chosen = matches.groupBy("by1").agg(F.max_by(
        F.struct("match", "score", "prefix_match_len", "edesc_count"),
        F.struct(F.col("edesc_count"), -F.col("rank"))).alias("s"))
    found = missing.join(chosen, "by1", "left").select(
        "by1", F.col("s.match").alias("source_by1"),
        F.bround("s.score", 4).alias("source_score"), "s.prefix_match_len", "s.edesc_count")
    success = F.col("source_by1").isNotNull()
    imported = found.select(
        "by1", success.alias("success"), F.when(success, F.concat(
            F.lit("Imported "), F.col("by1"), F.lit(" from "), F.col("source_by1")))
        .otherwise(F.concat(F.lit("No prefix candidates found for "), F.col("by1")))
        .alias("message"), "source_by1", "source_score", "prefix_match_len", "edesc_count",
        F.when(success, parent_id(F.col("by1"))).alias("parent_id"))
    kept = present.select("by1", F.lit(False).alias("success"), F.concat(
        F.lit("by1="), F.col("by1"), F.lit(" already exists")).alias("message"))
    copied = imported.filter("success").select("by1", "source_by1").join(
        texts.withColumnRenamed("by1", "source_by1"), "source_by1").select(
        "by1", "position", "text")
    return imported.unionByName(kept, allowMissingColumns=True), copied


def import_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("total"),
                      F.count_if("success").alias("success_count"),
                      F.count_if(~F.col("success")).alias("fail_count"))


def append_descriptions(new: DataFrame, texts: DataFrame,
                        products: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Append standardised descriptions to products, ignoring duplicates.

    new: seq (order of arrival), by1, description [, metadata map]; texts: by1, position, text.
    Returns (report per request, texts to add). A text already held by its product, or sent before
    in the same batch, is a duplicate. products may carry by1 and metadata to merge with.
    """
    request = new.withColumn("original", strip(F.col("description")))
    standardized = over_distinct(request, ["original"], lambda d: with_segments(
        d, "original").select("original", F.col("standardized").alias("text")))
    firsts = standardized.groupBy("by1", "text").agg(F.min("seq").alias("first_seq"))
    fresh = firsts.join(texts.select("by1", "text"), ["by1", "text"], "left_anti")
    placed = ordered_rank(fresh.withColumnRenamed("first_seq", "seq"), ["by1"], ["seq"], "nth")
    counts = product_counts(texts).withColumnRenamed("edesc_count", "before")
    added = placed.join(counts, "by1", "left").withColumn(
        "before", F.coalesce("before", F.lit(0)))
    accepted = added.withColumn("new_count", F.col("before") + F.col("nth")).select(
        "by1", "text", "seq", "new_count")
    # Each request sees the texts held before the batch and those accepted earlier in it.
    tagged = standardized.join(accepted.select("by1", "seq", F.lit(1).alias("is_new")),
                               ["by1", "seq"], "left").join(
        counts.withColumnRenamed("before", "held"), "by1", "left")
    accepted_before = ordered_accepts(tagged)
    count = F.coalesce("held", F.lit(0)) + F.col("accepted_before")
    is_new = F.col("is_new").isNotNull()
    report = accepted_before.select(
        "seq", "by1", "original", F.col("text").alias("standardized"),
        is_new.alias("success"),
        F.when(is_new & (count == 0), "created").when(is_new, "appended").otherwise("duplicate")
        .alias("action"), count.alias("old_edesc_count"),
        (count + F.when(is_new, 1).otherwise(0)).alias("new_edesc_count"),
        parent_id(F.col("by1")).alias("parent_id"),
        *([F.col("metadata")] if "metadata" in new.columns else []))
    if products is not None and "metadata" in new.columns:
        old = products.select("by1", F.col("metadata").alias("old_metadata"))
        empty = F.create_map().cast("map<string,string>")
        mine, theirs = F.coalesce("metadata", empty), F.coalesce("old_metadata", empty)
        report = report.join(old, "by1", "left").withColumn("metadata", F.map_concat(
            F.map_filter(theirs, lambda k, _: ~F.map_contains_key(mine, k)), mine)).drop(
            "old_metadata")
    return report, accepted.select("by1", (F.col("new_count") - 1).alias("position"), "text")


def ordered_accepts(tagged: DataFrame) -> DataFrame:
    """Adds accepted_before: accepted requests of the same product that arrived earlier.

    Requests of one product are numbered across tasks, and so are its accepted ones; the number of
    earlier accepted requests is the rank of the latest accepted one up to each request.
    """
    from pyspark.sql import Window
    ranked = ordered_rank(tagged, ["by1"], ["seq"], "nth")
    block = F.floor((F.col("nth") - 1) / 100_000)
    ranked = ranked.withColumns({"block": block, "one": F.coalesce("is_new", F.lit(0))})
    sums = ranked.groupBy("by1", "block").agg(F.sum("one").alias("in_block"))
    earlier = Window.partitionBy("by1").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    shift = sums.withColumn("shift", F.coalesce(F.sum("in_block").over(earlier), F.lit(0)))
    inside = Window.partitionBy("by1", "block").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, -1)
    return (ranked.withColumn("inside", F.coalesce(F.sum("one").over(inside), F.lit(0)))
            .join(shift.select("by1", "block", "shift"), ["by1", "block"])
            .withColumn("accepted_before", F.col("inside") + F.col("shift"))
            .drop("nth", "block", "one", "inside", "shift"))
