"""Mixing rows to target weights by iterative proportional fitting, in DataFrame functions only.

Token sums of all combinations of the margins (cells) are raked until every margin has its target
shares; a row is then kept with its cell's calibrated probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import unused, written


def uniform(row_id: Column) -> Column:
    """A number in [0, 1) that depends on row_id only; null counts as an empty id."""
    text = F.coalesce(row_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def smoothed_targets(cells: DataFrame, margins: list[str], exponent: float) -> DataFrame:
    """Cells with target_<margin>: the shares of the margin's values, tokens to the exponent."""
    for m in margins:
        own = (cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(exponent))
                                    .alias("_raw")))
        whole = Window.partitionBy(F.lit(0))
        own = own.select(m, (F.col("_raw") / F.sum("_raw").over(whole)).alias(f"target_{m}"))
        cells = cells.join(own, m)
    return cells


def rake(cells: DataFrame, margins: list[str], sweeps: int = 10) -> DataFrame:
    """Add weight: tokens fitted so that each margin's values have their target shares.

    cells: one row per combination of margins with tokens > 0 and target_<margin>. A sweep scales
    the weights to the targets of one margin after the other; the last margin fits exactly.
    """
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(sweeps):
        for m in margins:
            cells = cells.withColumn("weight", F.col("weight") * F.col(f"target_{m}")
                                     / F.sum("weight").over(Window.partitionBy(m)))
    return cells


def with_probabilities(cells: DataFrame, share: float, rounds: int = 6) -> DataFrame:
    """Add probability: of the cells' tokens so much is kept that share of all tokens remains and
    kept tokens follow the weights; a cell that has too few is kept whole and the rest scaled."""
    whole = Window.partitionBy(F.lit(0))
    cells = cells.withColumn("_scale", F.lit(share) * F.sum("tokens").over(whole)
                             / F.sum("weight").over(whole))
    for _ in range(rounds):
        full = F.col("_scale") * F.col("weight") >= F.col("tokens")
        rest = F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).over(whole)
        left = (F.lit(share) * F.sum("tokens").over(whole)
                - F.sum(F.when(full, F.col("tokens")).otherwise(0)).over(whole))
        cells = (cells.withColumns({"_rest": rest, "_left": left})
                 .withColumn("_scale", F.when(F.col("_rest") > 0, F.col("_left") / F.col("_rest"))
                             .otherwise(F.col("_scale"))).drop("_rest", "_left"))
    return cells.withColumn("probability", F.least(F.lit(1.0), F.round(
        F.col("_scale") * F.col("weight") / F.col("tokens"), 9))).drop("_scale")


def mix(rows: DataFrame, margins: list[str], share: float = 0.5, exponent: float = 0.5,
        sweeps: int = 10) -> DataFrame:
    """All columns of the rows with probability and kept.

    rows: row_id, tokens and the margin columns, for order lines such as customer, form_code and
    by1. Targets are the values' token shares to the power of exponent. A null margin is the value
    '', a null or negative token count is 0 and such a row has probability 0 and is not kept.
    Rows with one row_id are kept or left together. Cells are as many as combinations of margin
    values and are summed before any shuffle, so a value that holds most rows is one small sum.
    """
    keys = {unused(f"_{m}", rows.columns): F.coalesce(F.col(m).cast("string"), F.lit(""))
            for m in margins}
    named, counted = list(keys), unused("_tokens", rows.columns)
    tokens = F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(0)), F.lit(0))
    marked = rows.drop("probability", "kept").withColumns({**keys, counted: tokens})
    cells = (marked.filter(F.col(counted) > 0).groupBy(*named)
             .agg(F.sum(counted).alias("tokens")))
    fitted = with_probabilities(rake(smoothed_targets(written(cells, "cells"), named, exponent),
                                     named, sweeps), share)
    fitted = written(fitted.select(*named, "probability"), "fitted")
    return (marked.join(fitted, named, "left")
            .withColumn("probability", F.when(F.col(counted) > 0, F.col("probability"))
                        .otherwise(0.0))
            .withColumn("kept", uniform(F.col("row_id")) < F.col("probability"))
            .drop(*named, counted))
