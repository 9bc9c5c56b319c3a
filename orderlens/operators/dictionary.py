"""Business dictionary: term and exception tables, phrase matching, the compiled bundle."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, is_active, strip

# The built-in terms as (term, value, field, families, priority).
DEFAULT_TERMS = [
    ("DUCTILE IRON", "DUCTILE IRON", "body_material", "", 20),
    ("DI", "DUCTILE IRON", "body_material", "", 10),
    ("CAST IRON", "CAST IRON", "body_material", "", 20),
    ("CI", "CAST IRON", "body_material", "", 10),
    ("CARBON STEEL", "CARBON STEEL", "body_material", "", 20),
    ("CS", "CARBON STEEL", "body_material", "", 10),
    ("LUG WAFER", "LUG WAFER", "connection", "", 30),
    ("LUGGED WAFER", "LUG WAFER", "connection", "", 30),
    ("GROOVED", "GROOVED", "connection", "", 20),
    ("GRVD", "GROOVED", "connection", "", 20),
    ("GRV", "GROOVED", "connection", "", 10),
    ("FLANGED", "FLANGED", "connection", "", 20),
    ("FLGD", "FLANGED", "connection", "", 20),
    ("FLG", "FLANGED", "connection", "", 10),
    ("THREADED", "THREADED", "connection", "", 20),
    ("THD", "THREADED", "connection", "", 10),
    ("WAFER", "WAFER", "connection", "", 10),
    ("LUG", "LUG", "connection", "", 10),
    ("EPDM SEAT", "EPDM", "seat_material", "", 20),
    ("EPDM", "EPDM", "seat_material", "", 10),
    ("BUNA-N", "NBR", "seat_material", "", 20),
    ("NITRILE", "NBR", "seat_material", "", 20),
    ("NBR", "NBR", "seat_material", "", 10),
    ("PTFE", "PTFE", "seat_material", "", 10),
    ("VITON", "VITON", "seat_material", "", 10),
    ("DI+EPDM DISC", "DUCTILE IRON WITH EPDM COATED", "closure_material", "", 40),
    ("DI + EPDM DISC", "DUCTILE IRON WITH EPDM COATED", "closure_material", "", 40),
    ("SS316 DISC", "STAINLESS STEEL 316", "closure_material", "", 30),
    ("316 SS DISC", "STAINLESS STEEL 316", "closure_material", "", 30),
    ("SS304 DISC", "STAINLESS STEEL 304", "closure_material", "", 30),
    ("304 SS DISC", "STAINLESS STEEL 304", "closure_material", "", 30),
    ("DI DISC", "DUCTILE IRON", "closure_material", "", 20),
    ("GEAR OPERATED", "GEAR OPERATED", "actuation", "", 30),
    ("WORM GEAR", "GEAR OPERATED", "actuation", "", 30),
    ("GEAR", "GEAR OPERATED", "actuation", "", 10),
    ("HANDWHEEL", "HANDWHEEL OPERATED", "actuation", "", 20),
    ("LEVER", "LEVER OPERATED", "actuation", "", 10),
    ("MOTORIZED", "MOTORIZED", "actuation", "", 20),
    ("PNEUMATIC", "PNEUMATIC OPERATED", "actuation", "", 20),
    ("FIRE RISER", "FIRE RISER", "structure", "butterfly", 30),
    ("TRIPLE ECCENTRIC", "TRIPLE ECCENTRIC", "structure", "butterfly", 30),
    ("DOUBLE ECCENTRIC", "DOUBLE ECCENTRIC", "structure", "butterfly", 30),
    ("DUAL PLATE", "DUAL PLATE", "structure", "check", 30),
    ("D.D.", "DUAL PLATE", "structure", "check", 20),
    ("SWING", "SWING", "structure", "check", 20),
    ("SILENT", "SILENT", "structure", "check", 20),
    ("BALL CHECK", "BALL", "structure", "check", 30),
    ("OS&Y", "OS&Y", "structure", "gate", 30),
    ("OSY", "OS&Y", "structure", "gate", 20),
    ("NON-RISING STEM", "NON-RISING STEM", "structure", "gate", 30),
    ("NRS", "NON-RISING STEM", "structure", "gate", 20),
    ("KNIFE GATE", "KNIFE", "structure", "gate", 30),
    ("AWWA C508", "AWWA C508", "standard_certification", "check", 30),
    ("UL/FM", "UL LISTED / FM APPROVED", "standard_certification", "", 30),
    ("UL FM", "UL LISTED / FM APPROVED", "standard_certification", "", 20),
]
TERM_SCHEMA = ("raw_term string, canonical_term string, field string, family_scope string, "
               "priority int, active boolean, position int")
EXCEPTION_SCHEMA = ("match_field string, match_value string, override_field string, "
                    "override_value string, reason string, active boolean, position int")
EXCEPTION_PRIORITY = 10_000
MATCH_TYPE = "map<string,struct<value:string,term:string,priority:int>>"


@dataclass(frozen=True)
class Dictionary:
    """Cleaned term and exception tables of any size; without exceptions None."""

    terms: DataFrame
    exceptions: DataFrame | None = None


def default_terms(spark: SparkSession) -> DataFrame:
    rows = [(t, v, f, s, p, True, i) for i, (t, v, f, s, p) in enumerate(DEFAULT_TERMS)]
    return spark.createDataFrame(rows, TERM_SCHEMA)


def clean_terms(terms: DataFrame) -> DataFrame:
    """Active complete term rows with a lower-case family list."""
    families = F.filter(F.transform(F.split(blank(F.col("family_scope")), ","),
                                    lambda x: F.lower(strip(x))), lambda x: x != "")
    cleaned = terms.filter(is_active(F.col("active"))).select(
        strip(blank(F.col("raw_term"))).alias("term"),
        strip(blank(F.col("canonical_term"))).alias("value"),
        strip(blank(F.col("field"))).alias("field"), families.alias("families"),
        F.coalesce(F.col("priority"), F.lit(0)).cast("int").alias("priority"), "position")
    return cleaned.filter((F.col("term") != "") & (F.col("value") != "") & (F.col("field") != ""))


def clean_exceptions(exceptions: DataFrame) -> DataFrame:
    """Active exception rows with all four match and override values."""
    names = ["match_field", "match_value", "override_field", "override_value"]
    cleaned = exceptions.filter(is_active(F.col("active"))).select(
        *[strip(blank(F.col(n))).alias(n) for n in names], "position")
    return cleaned.filter(reduce(lambda a, b: a & b, [F.col(n) != "" for n in names]))


def load_dictionary(terms: DataFrame, exceptions: DataFrame | None = None) -> Dictionary:
    """Clean the tables of a reviewed dictionary; nothing of them comes to the driver."""
    return Dictionary(clean_terms(terms),
                      None if exceptions is None else clean_exceptions(exceptions))


def default_dictionary(spark: SparkSession) -> Dictionary:
    return Dictionary(clean_terms(default_terms(spark)))


def _packed(rows: DataFrame, keys: list[str], name: str, field: str) -> DataFrame:
    """One map field -> (value, term, priority) per key from rows with one row per field."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col(field).alias("key"), F.struct("value", "term", "priority").alias("value"))))
        .cast(MATCH_TYPE).alias(name))


def match_terms(texts: DataFrame, terms: DataFrame, keys: list[str], text: str,
                family: str) -> DataFrame:
    """Best term per key and field, for dictionaries of any size.

    The longest phrase per field wins, then the highest priority, then the earlier row. A phrase
    starts and ends at word edges, so its first word occurs as a word of the text: texts and terms
    meet on that word, then the phrase itself is tested; phrases without a word meet every text.
    """
    word = r"[A-Z0-9]+"
    upper = F.upper(F.col("term"))
    escaped = F.regexp_replace(upper, r"([^A-Za-z0-9\s])", r"\\$1")
    pattern = F.concat(F.lit("(?<![A-Z0-9])"), F.regexp_replace(escaped, " ", r"\\s+"),
                       F.lit("(?![A-Z0-9])"))
    rules = terms.select(
        "*", F.regexp_extract(upper, f"({word})", 1).alias("word"), pattern.alias("pattern"))
    found = F.regexp_extract_all(F.col(text), F.lit(f"({word})"), F.lit(1))
    words = texts.select(*keys, text, family, F.explode(F.array_distinct(
        F.concat(F.array(F.lit("")), found))).alias("word"))
    met = words.join(rules, "word").filter(
        ((F.size("families") == 0) | F.array_contains("families", F.col(family)))
        & F.regexp_like(F.col(text), F.col("pattern")))
    return met.groupBy(*keys, "field").agg(F.max_by(
        F.struct("value", "term", "priority"),
        F.struct(F.length("term"), F.col("priority"), -F.col("position"))).alias("match")).select(
        *keys, "field", "match.*")


def with_matches(texts: DataFrame, terms: DataFrame, keys: list[str], text: str,
                 family: str) -> DataFrame:
    """Add found, the map field -> (value, term, priority) of match_terms; keys are not null."""
    packed = _packed(match_terms(texts, terms, keys, text, family), keys, "found", "field")
    return texts.join(packed, keys, "left").withColumn(
        "found", F.coalesce("found", F.create_map().cast(MATCH_TYPE)))


def _pieces(text: Column, n: int) -> Column:
    """All stretches of n characters of a description, as (name, mark)."""
    def piece(i: Column) -> Column:
        return F.struct(F.lit("description").alias("name"),
                        F.substring(text, i, F.lit(n)).alias("mark"))

    return F.when(F.char_length(text) >= n, F.transform(
        F.sequence(F.lit(1), F.char_length(text) - (n - 1)), piece)).otherwise(
        F.array().cast("array<struct<name:string,mark:string>>"))


def with_exceptions(rows: DataFrame, exceptions: DataFrame, keys: list[str],
                    context: dict[str, str]) -> DataFrame:
    """Override found by the exceptions whose condition holds; later rows win.

    context: field name -> column with its upper-case value. A description matches by substring:
    text and exception meet on the first characters of the wanted value, up to three. Other
    fields match by equality. keys identify a context and are not null.
    """
    wanted = exceptions.select(
        F.lower("match_field").alias("name"), F.upper("match_value").alias("wanted"),
        "match_value", "override_field", "override_value", "position").withColumn(
        "mark", F.when(F.col("name") == "description", F.left("wanted", F.lit(3)))
        .otherwise(F.col("wanted")))
    contexts = rows.select(*dict.fromkeys([*keys, *context.values()])).dropDuplicates(keys)
    text = F.col(context["description"])
    starts = [_pieces(text, n) for n in (1, 2, 3)]
    equal = F.array(*[F.struct(F.lit(name).alias("name"), F.col(column).alias("mark"))
                      for name, column in context.items() if name != "description"])
    met = contexts.withColumn("_at", F.explode(F.array_distinct(F.concat(*starts, equal)))).select(
        *keys, text.alias("_whole"), "_at.*")
    hits = met.join(wanted, ["name", "mark"]).filter(
        (F.col("name") != "description") | F.contains("_whole", F.col("wanted")))
    last = hits.groupBy(*keys, "override_field").agg(F.max_by(F.struct(
        F.col("override_value").alias("value"),
        F.concat(F.lit("EXCEPTION:"), "match_value").alias("term"),
        F.lit(EXCEPTION_PRIORITY).alias("priority")), "position").alias("change")).select(
        *keys, "override_field", "change.*")
    changed = rows.join(_packed(last, keys, "_changes", "override_field"), keys, "left")
    changes = F.coalesce("_changes", F.create_map().cast(MATCH_TYPE))
    kept = F.map_filter("found", lambda k, _: ~F.map_contains_key(changes, k))
    return changed.withColumn("found", F.map_concat(kept, changes)).drop("_changes")


def canonical_values(terms: DataFrame) -> DataFrame:
    """Distinct (field, canonical value, family scope) of the cleaned terms."""
    return terms.select("field", F.col("value").alias("canonical_value"),
                        F.array_join("families", ",").alias("family_scope")).distinct()


def compile_bundle(sheets: dict[str, DataFrame], version: str) -> tuple[DataFrame, DataFrame]:
    """Long rows of all sheets (sheet, row_no, column, value) and a one-row manifest.

    Blank rows are dropped. The manifest holds the version, the row counts and a SHA-256 over the
    content, taken per row first and then folded in a tree over the sorted row hashes.
    """
    parts = []
    for name, df in sheets.items():
        columns = [c for c in df.columns if c != "position"]
        filled = df.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns]))
        cells = F.array(*[F.struct(F.lit(c).alias("column"),
                                   F.col(c).cast("string").alias("value")) for c in columns])
        parts.append(filled.select(F.lit(name).alias("sheet"), F.col("position").alias("row_no"),
                                   F.explode(cells).alias("cell")).select(
            "sheet", "row_no", "cell.column", "cell.value"))
    rows = reduce(DataFrame.unionByName, parts)
    line = F.concat_ws("|", "sheet", F.col("row_no").cast("string"), "column", blank(F.col("value")))
    return rows, content_digest(rows.select(F.sha2(line, 256).alias("h"))).select(
        F.col("h").alias("source_sha256"), F.lit(version).alias("version"))


def content_digest(hashes: DataFrame) -> DataFrame:
    """One row: SHA-256 over the hashes (column h, hex) whatever their order.

    Hashes are folded in a tree by ever shorter prefixes, so a fold takes 16 hashes or, at the
    leaves, those that share a prefix; the prefix length follows from the count.
    """
    n, digits = hashes.count(), 0
    while 16 ** digits * 64 < n:
        digits += 1
    fold = F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h")
    level = hashes.select("h")
    for width in range(digits, 0, -1):
        level = level.groupBy(F.substring("h" if width == digits else "at", 1, width).alias("at")) \
            .agg(fold)
    return level.agg(fold)
