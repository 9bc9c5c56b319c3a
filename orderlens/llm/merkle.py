"""Merkle trees over the sections and paragraphs of descriptions, in column functions only.

A text is cut at blank lines into sections, at line ends into paragraphs and after a punctuation
mark with a blank into clauses. A clause is hashed, and a paragraph, section and the root hash the
hashes below them, so equal roots mean equal texts and unequal branches lead to the edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import unused

CLAUSE_END = r"(?<=[.,;:!?|]) "


def _joined(nodes: Column) -> Column:
    return F.md5(F.array_join(F.transform(nodes, lambda x: x["hash"]), ""))


def clauses(text: Column) -> Column:
    """Hashes and lengths of the clauses by section and paragraph; null counts as empty."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n\n"),
        lambda section: F.transform(
            F.split(section, "\n"),
            lambda paragraph: F.transform(
                F.split(paragraph, CLAUSE_END),
                lambda clause: F.struct(F.md5(clause).alias("hash"),
                                        F.char_length(clause).alias("size")))))


def with_tree(rows: DataFrame, text: str, tree: str) -> DataFrame:
    """Add the Merkle tree of a text column.

    tree: struct root, sections array<struct hash, paragraphs array<struct hash, clauses
    array<struct hash, size>>>>. It is built level by level, each level once.
    """
    level = unused("_level", rows.columns)
    rows = rows.withColumn(level, clauses(F.col(text)))
    rows = rows.withColumn(level, F.transform(level, lambda section: F.transform(
        section, lambda paragraph: F.struct(_joined(paragraph).alias("hash"),
                                            paragraph.alias("clauses")))))
    rows = rows.withColumn(level, F.transform(level, lambda section: F.struct(
        _joined(section).alias("hash"), section.alias("paragraphs"))))
    return rows.withColumn(tree, F.struct(_joined(F.col(level)).alias("root"),
                                          F.col(level).alias("sections"))).drop(level)


def fingerprint(tree: Column) -> Column:
    """The tree as text: root, then /section ;paragraph ,clause.size with 8 digits of each hash."""
    return F.concat(tree["root"], F.array_join(F.transform(
        tree["sections"], lambda s: F.concat(
            F.lit("/"), F.left(s["hash"], F.lit(8)), F.array_join(F.transform(
                s["paragraphs"], lambda p: F.concat(
                    F.lit(";"), F.left(p["hash"], F.lit(8)), F.array_join(F.transform(
                        p["clauses"], lambda c: F.concat(
                            F.lit(","), F.left(c["hash"], F.lit(8)), F.lit("."),
                            c["size"].cast("string"))), ""))), ""))), ""))


def leaves(fingerprint_: Column) -> Column:
    """Distinct clause codes (hash.size) of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(
        fingerprint_, F.lit(r",([0-9a-f]{8}\.[0-9]+)"), F.lit(1)))


def _weight(codes: Column) -> Column:
    return F.aggregate(codes, F.lit(0).cast("long"),
                       lambda n, code: n + F.substring(code, 10, 20).cast("long"))


def likeness(rows: DataFrame, one: str, other: str, name: str) -> DataFrame:
    """Add the share of characters in common clauses among those of all clauses, 0 to 1.

    one, other: array columns from leaves(). Without any character the share is 1 if the same
    clauses stand on both sides, else 0.
    """
    rows = (rows.withColumn("_both", _weight(F.array_intersect(one, other)))
            .withColumn("_all", _weight(F.col(one)) + _weight(F.col(other)) - F.col("_both")))
    same = F.size(F.array_except(one, other)) + F.size(F.array_except(other, one)) == 0
    return rows.withColumn(name, F.when(F.col("_all") > 0, F.col("_both") / F.col("_all"))
                           .otherwise(same.cast("double"))).drop("_both", "_all")


def changed_paragraphs(one: Column, other: Column) -> Column:
    """Places (section, paragraph, from 0) whose branches differ; empty for equal roots.

    one, other: trees. Sections with equal hashes are not entered; a section or paragraph that
    only one side has counts as changed.
    """
    def inside(a: Column, b: Column, section: Column) -> Column:
        last = F.greatest(F.size(F.coalesce(a["paragraphs"], F.array())),
                          F.size(F.coalesce(b["paragraphs"], F.array()))) - 1
        return F.filter(F.transform(F.sequence(F.lit(0), last), lambda p: F.struct(
            section.alias("section"), p.alias("paragraph"),
            F.get(a["paragraphs"], p)["hash"].eqNullSafe(F.get(b["paragraphs"], p)["hash"])
            .alias("same"))), lambda x: ~x["same"])

    last = F.greatest(F.size(one["sections"]), F.size(other["sections"])) - 1
    found = F.flatten(F.transform(F.filter(
        F.sequence(F.lit(0), last),
        lambda s: ~F.get(one["sections"], s)["hash"].eqNullSafe(F.get(other["sections"], s)["hash"])),
        lambda s: inside(F.get(one["sections"], s), F.get(other["sections"], s), s)))
    places = F.transform(found, lambda x: F.struct(x["section"], x["paragraph"]))
    return F.when(one["root"] == other["root"], F.slice(places, 1, 0)).otherwise(places)


def with_next(rows: DataFrame, next_name: str = "next_description",
              parts: int | None = None) -> DataFrame:
    """Add the description of the next row in descending row_id; after the last comes the first.

    Rows are dealt into parts by quantiles of row_id (their number is that of the shuffle
    partitions), the next row is looked up inside a part and, for a part's last row, in the first
    row of the part below. Rows with equal row_id follow in descending description, null row_id
    and null descriptions last. One shuffle of the texts.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("row_id").cast("long")
    bounds = sorted({int(b) for b in rows.select(key.alias("row_id")).approxQuantile(
        "row_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]),
                           lambda b: b < key)) if bounds else F.lit(0)
    dealt = rows.withColumn("_part", F.coalesce(F.when(key.isNull(), F.lit(0)).otherwise(part),
                                                F.lit(0)))
    order = Window.partitionBy("_part").orderBy(
        F.col("row_id").desc_nulls_last(), F.col("description").desc_nulls_last())
    inside = (dealt.withColumn("_inside", F.lead("description").over(order))
              .withColumn("_more", F.lead(F.lit(True), 1, False).over(order)))
    top = dealt.groupBy("_part").agg(F.max_by("description", F.struct(
        F.col("row_id").isNotNull(), "row_id", F.col("description").isNotNull(), "description"))
        .alias("_head"))
    every = Window.orderBy(F.col("_part").desc())
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = top.select("_part", F.when(
        F.lead(F.lit(True), 1, False).over(every), F.lead("_head").over(every))
        .otherwise(F.first("_head").over(whole)).alias("_below"))
    return (inside.join(below, "_part")
            .withColumn(next_name, F.when(F.col("_more"), F.col("_inside"))
                        .otherwise(F.col("_below")))
            .drop("_part", "_inside", "_more", "_below"))


def edited(text: Column, following: Column) -> Column:
    """The text whose last floor(n/2) code points gave way to as many first ones of another."""
    own, other = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    half = F.floor(F.char_length(own) / 2).cast("int")
    return F.concat(F.substring(own, F.lit(1), F.char_length(own) - half),
                    F.substring(other, F.lit(1), half))


def description_fingerprints(rows: DataFrame) -> DataFrame:
    """Fingerprints of description rows, of their edited texts, and how alike they are.

    rows: row_id (long), description; returns row_id, n_chars, edited (text), fingerprint,
    edited_fingerprint, near_edited and near_next. Null descriptions count as empty; an only row
    is its own next row.
    """
    both = with_next(rows.select("row_id", "description"))
    both = both.withColumn("edited", edited(F.col("description"), F.col("next_description")))
    for text, name in (("description", "fingerprint"), ("edited", "edited_fingerprint"),
                       ("next_description", "next_fingerprint")):
        both = with_tree(both, text, "_tree").withColumn(name, fingerprint(F.col("_tree")))
        both = both.withColumn("_" + name, leaves(F.col(name))).drop("_tree")
    both = likeness(both, "_fingerprint", "_edited_fingerprint", "near_edited")
    both = likeness(both, "_fingerprint", "_next_fingerprint", "near_next")
    return both.select("row_id", F.coalesce(F.char_length("description"), F.lit(0)).cast("long")
                       .alias("n_chars"), "edited", "fingerprint", "edited_fingerprint",
                       "near_edited", "near_next")
