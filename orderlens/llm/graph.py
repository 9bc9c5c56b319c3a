"""Connected classes of links by repeated joins, nothing of them on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import written


def connected(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every id that has a link.

    links: a, b (longs, any order, repeats and loops allowed). Returns id, component. In a round
    every id points to its smallest neighbour or itself, ids take over the pointer of their
    pointer, and links are drawn between the ends; ids that remain linked at least halve with each
    round, so few rounds are needed. Both sides of each join are written tables, so adaptive
    execution can split an id that holds many links. Rounds are tables in the shared folder.
    """
    edges = written(links.filter(F.col("a") != F.col("b"))
                    .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .distinct(), "links")
    place = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.min("b").alias("low"))
                       .select(F.col("a").alias("id"), F.least("a", "low").alias("up")), "step")
        if not step.head(1):
            break
        above = step.select(F.col("id").alias("up"), F.col("up").alias("top"))
        for _ in range(2):
            step = written(step.join(above, "up", "left").select(
                "id", F.coalesce("top", "up").alias("up")), "step")
            above = step.select(F.col("id").alias("up"), F.col("up").alias("top"))
        place = step if place is None else written(
            place.withColumnRenamed("up", "at").join(
                step.select(F.col("id").alias("at"), F.col("up")), "at", "left")
            .select("id", F.coalesce("up", "at").alias("up")), "place")
        ends = step.select(F.col("id"), F.col("up"))
        edges = written(
            edges.join(ends.select(F.col("id").alias("a"), F.col("up").alias("x")), "a", "left")
            .join(ends.select(F.col("id").alias("b"), F.col("up").alias("y")), "b", "left")
            .select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
            .filter(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            "links")
    if place is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return place.withColumnRenamed("up", "component")
