"""Text column functions. Every function maps columns to columns; none needs Python workers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware \w, \b, \s and \d for the Java regex engine.
UNICODE = "(?U)"
# SHA-256 of the empty string.
NO_NAME = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def rx(pattern: str) -> str:
    return UNICODE + pattern


def let(value: Column, use) -> Column:
    """Evaluate value once and hand it to use, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has(text: Column, *needles: str) -> Column:
    """True if any of the literal needles occurs in the text."""
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A capture group of the first match, null if there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(text, rx(pattern), group), F.lit(""))


def all_groups(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern)), F.lit(group))


def sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, rx(pattern), replacement)


def strip(text: Column) -> Column:
    return sub(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(sub(text, r"\s+", " "))


def blank(text: Column) -> Column:
    """Null-safe string: null becomes the empty string."""
    return F.coalesce(text.cast("string"), F.lit(""))


def normalize_text(value: Column) -> Column:
    """Upper case, BUNA-N as NBR, every run of non-alphanumerics as one blank."""
    upper = F.replace(F.upper(blank(value)), F.lit("BUNA-N"), F.lit("NBR"))
    return F.trim(F.regexp_replace(upper, r"[^\p{L}\p{N}]+", " "))


def normalize_code(value: Column) -> Column:
    """Upper case without white space."""
    return sub(F.upper(blank(value)), r"\s+", "")


def fingerprint(value: Column) -> Column:
    """SHA-256 of a normalised name, so that results never hold customer names."""
    # The digest of no name is cut out behind, so that the name is normalised once.
    return F.replace(F.sha2(normalize_text(value), 256), F.lit(NO_NAME), F.lit(""))


def token_set(normalized: Column) -> Column:
    """Distinct tokens of a normalised text; empty text has no tokens."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: t != ""))


def split_context(query: Column, customer: Column, form_code: Column) -> Column:
    """``customer[SEP]description[SEP]form`` as a struct; explicit fields win."""
    raw = strip(blank(query))
    parts = F.split(raw, rx(r"(?i)\s*\[SEP\]\s*"), 3)
    joined = F.contains(F.upper(raw), F.lit("[SEP]"))

    def part(i: int) -> Column:
        return strip(F.coalesce(F.get(parts, F.lit(i)), F.lit("")))

    def explicit(value: Column, i: int) -> Column:
        given = strip(blank(value))
        return F.when(given != "", given).otherwise(F.when(joined, part(i)).otherwise(F.lit("")))

    text = F.when(joined, part(1)).otherwise(raw)
    return F.struct(
        text.alias("query"),
        explicit(customer, 0).alias("customer"),
        explicit(form_code, 2).alias("form_code"),
        F.when(text == "", F.lit("missing_description")).otherwise(F.lit("ok")).alias("status"),
    )


def prefix_length(left: Column, right: Column) -> Column:
    """Length of the common prefix, ignoring case."""
    a, b = F.upper(blank(left)), F.upper(blank(right))
    shorter = F.least(F.length(a), F.length(b))
    positions = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(
        F.array().cast("array<int>"))
    return F.size(F.filter(positions, lambda i: F.left(a, i) == F.left(b, i)))


def prefix_similarity(left: Column, right: Column) -> Column:
    longer = F.greatest(F.length(blank(left)), F.length(blank(right)))
    return F.when(longer > 0, prefix_length(left, right) / longer).otherwise(F.lit(0.0))


def prefix_match_len(left: Column, right: Column) -> Column:
    longer = F.greatest(F.length(blank(left)), F.length(blank(right)))
    return (prefix_similarity(left, right) * longer).cast("int")


# Answers accepted as yes and as no.
YES_WORDS = ["yes", "y", "true", "1", "是", "通过"]
NO_WORDS = ["no", "n", "false", "0", "否", "不通过"]
INACTIVE_WORDS = ["false", "0", "no", "off"]


def approval(value: Column) -> Column:
    """True, false, or null for anything that is not an answer."""
    word = F.lower(strip(blank(value)))
    return F.when(word.isin(YES_WORDS), True).when(word.isin(NO_WORDS), False)


def corrected_or(corrected: Column, predicted: Column) -> Column:
    fixed = strip(blank(corrected))
    return F.when(fixed != "", fixed).otherwise(strip(blank(predicted)))


def is_active(value: Column) -> Column:
    return ~F.lower(strip(F.coalesce(value.cast("string"), F.lit("true")))).isin(INACTIVE_WORDS)


def safe_date(value: Column) -> Column:
    """Date of a date, a timestamp or an ISO string; null for anything else."""
    return F.try_to_date(F.substring(strip(value.cast("string")), 1, 10), "yyyy-MM-dd")


def iso_prefix(value: Column) -> Column:
    return F.substring(blank(value), 1, 10)
