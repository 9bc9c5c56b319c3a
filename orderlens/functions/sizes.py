"""Sizes and pressures: inch, DN and millimetre notations as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import lookup, normalize_number
from .text import all_groups, collapse, first_group, let, matches, rx

# Nominal sizes.
INCH_TO_DN = {1.5: 40, 2: 50, 2.5: 65, 3: 80, 4: 100, 5: 125, 6: 150, 8: 200, 10: 250, 12: 300,
              14: 350, 16: 400, 18: 450, 20: 500, 24: 600, 28: 700, 32: 800, 36: 900, 40: 1000,
              48: 1200}
# Whole millimetre sizes and their nominal size.
MM_TO_DN = {48: 40, 50: 50, 60: 50, 63: 50, 65: 65, 73: 65, 76: 65, 80: 80, 89: 80, 100: 100,
            108: 100, 114: 100, 125: 125, 133: 125, 140: 125, 150: 150, 159: 150, 165: 150,
            168: 150, 200: 200, 216: 200, 219: 200, 250: 250, 267: 250, 273: 250, 300: 300,
            324: 300, 325: 300, 350: 350, 356: 350, 400: 400, 406: 400, 450: 450, 457: 450,
            500: 500, 508: 500, 600: 600, 610: 600, 700: 700, 711: 700, 800: 800, 813: 800}
# Pipe outside diameters of grooved ends, by nominal size and by inch.
GROOVED_DN_TO_OD = {"50": "60", "65": "76", "80": "89", "100": "114", "125": "140", "150": "168",
                    "200": "219", "250": "273", "300": "324", "350": "356", "400": "406",
                    "450": "457", "500": "508", "600": "610"}
GROOVED_INCH_TO_OD = {2: "60", 2.5: "76", 3: "89", 4: "114", 5: "140", 6: "168", 8: "219",
                      10: "273", 12: "324", 14: "356", 16: "406", 18: "457", 20: "508", 24: "610"}
GROOVED_PRODUCT_OD = {"GD48638N": {2.5: "73", 5: "141"}}
# Measured reliability of each size rule.
SIZE_RULE_RELIABILITY = {
    "dn_size": 0.997, "explicit_mm": 0.999, "suitable_range_max": 1.0,
    "grooved_explicit_mm": 0.999, "grooved_inch_to_od": 0.992, "grooved_dn_to_od": 0.995,
    "grooved_cts_inch_to_od": 1.0, "grooved_product_inch_to_od": 1.0}
# Design sizes.
DESIGN_DN_TO_INCH = {40: "1 1/2", 50: "2", 65: "2 1/2", 80: "3", 100: "4", 125: "5", 150: "6",
                     200: "8", 250: "10", 300: "12", 350: "14", 400: "16", 450: "18", 500: "20",
                     600: "24", 700: "28", 800: "32", 900: "36"}
DESIGN_DN_TO_OD = {50: 60, 65: 73, 80: 89, 100: 114, 125: 140, 150: 168, 200: 219, 250: 273,
                   300: 324}
# Size patterns.
DN_PATTERN = r"(?i)\bDN\s*(\d+(?:\.\d+)?)\b"
MM_PATTERN = r"(?i)\b(\d+(?:\.\d+)?)\s*MM\b"
INCH_PATTERN = (r"(?<![\d/])(\d+\s*[- ]\s*\d+/\d+|\d+/\d+|\d+(?:\.\d+)?)"
                "\\s*[\"\u201d\u2033]")
COPPER_INCH_PATTERN = r"(?i)\b(\d+(?:\.\d+)?)\s+(?:COP|COPPER)\b"
GROOVED_PATTERN = r"(?i)\b(?:GROOVED|GROOVE|GRVD|GRV)\b|\bBVG-"
SUITABLE_PATTERN = r"(?i)\bSUIT(?:ABLE)?\s+FOR\b"
COPPER_PATTERN = r"(?i)\b(?:CTS|COP|COPPER)\b"

DECIMAL = "decimal(18,8)"


def plain_int(digits: Column) -> Column:
    """Digits without leading zeroes."""
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def inch_value(text: Column) -> Column:
    """``1 1/2``, ``3/4`` or ``4`` as a double; 0 for anything else."""
    def parse(parts: Column) -> Column:
        whole = F.coalesce(F.nullif(F.get(parts, F.lit(0)), F.lit("")).try_cast("double"),
                           F.lit(0.0))
        return whole + F.try_divide(F.get(parts, F.lit(1)).try_cast("double"),
                                    F.get(parts, F.lit(2)).try_cast("double"))

    pieces = F.split(F.regexp_replace(text, rx(r"^(?:(\d+)\s+)?(\d+)/(\d+)$"), "$1|$2|$3"), r"\|")
    return F.coalesce(F.when(F.contains(text, F.lit("/")), parse(pieces))
                      .otherwise(text.try_cast("double")), F.lit(0.0))


def format_inch(value: Column) -> Column:
    """A double as ``4``, ``2 1/2`` or, without a common fraction, one decimal."""
    def write(inch: Column) -> Column:
        whole = F.floor(inch).cast("bigint")
        rest = inch - F.floor(inch)

        def near(x: float) -> Column:
            return F.abs(rest - F.lit(x)) < 0.01

        common = (F.when(near(0.25), "1/4").when(near(0.5), "1/2").when(near(0.75), "3/4")
                  .when(near(0.333), "1/3").when(near(0.667), "2/3"))
        return (F.when(rest == 0, whole.cast("string"))
                .when(common.isNotNull(), F.concat_ws(
                    " ", F.when(whole > 0, whole.cast("string")), common))
                .when(inch.isNotNull(), F.format_string("%.1f", inch)))

    return let(value, write)


def _double_keys(table: dict) -> dict:
    return {float(k): str(v) for k, v in table.items()}


def nominal_size(text: Column) -> Column:
    """``4"/DN100``, ``4"`` or ``DN100`` from the first size notation in an upper-case text."""
    number = r"(\d+(?:\s+\d+/\d+)?)"
    pair = number + r'\s*"\s*/\s*(?:DN(\d+)|(\d+(?:\.\d+)?)\s*MM)'
    # The blank inside a mixed fraction is dropped before parsing: 1 1/2 reads as 11/2 here.
    pair_inch = F.replace(F.regexp_extract(text, rx(pair), 1), F.lit(" "), F.lit(""))
    found = F.struct(
        pair_inch.alias("pair_inch"), plain_int(first_group(text, pair, 2)).alias("pair_dn"),
        first_group(text, pair, 3).try_cast("double").alias("pair_mm"),
        first_group(text, number + r'\s*"', 1).alias("inch"),
        plain_int(first_group(text, r"DN(\d+)")).alias("dn"),
        first_group(text, "^" + number + r"\s", 1).alias("lead"))

    def write(f: Column) -> Column:
        mm_int = f["pair_mm"].cast("bigint")
        mm_dn = F.coalesce(lookup({k: str(v) for k, v in MM_TO_DN.items()}, mm_int.cast("int")),
                           mm_int.cast("string"))
        paired = F.when(f["pair_dn"] != "0", f["pair_dn"]).when(
            f["pair_dn"].isNull() & (f["pair_mm"] > 0), mm_dn)
        dn_inch = lookup({v: float(k) for k, v in INCH_TO_DN.items()}, f["dn"].try_cast("int"))
        # One (inch, DN) choice, in order of precedence; each part may be missing.
        choice = F.coalesce(
            F.when(paired.isNotNull(), F.struct(inch_value(f["pair_inch"]).alias("inch"),
                                                paired.alias("dn"))),
            F.when(f["inch"].isNotNull(), let(inch_value(f["inch"]), lambda v: F.struct(
                v.alias("inch"), lookup(_double_keys(INCH_TO_DN), v).alias("dn")))),
            F.when(f["dn"].isNotNull(), F.struct(dn_inch.alias("inch"), f["dn"].alias("dn"))),
            F.when(f["lead"].isNotNull(), let(inch_value(f["lead"]), lambda v: F.struct(
                v.alias("inch"), lookup(_double_keys(INCH_TO_DN), v).alias("dn")))))
        return let(choice, lambda c: F.concat_ws(
            "/", F.concat(format_inch(c["inch"]), F.lit('"')), F.concat(F.lit("DN"), c["dn"])))

    return let(found, write)


def pressure(text: Column) -> Column:
    """PSI before PN before BAR, digits as written; upper-case text."""
    psi = first_group(text, r"(\d+)\s*PSI")
    pn = first_group(text, r"\bPN(\d+)\b")
    bar = first_group(text, r"(\d+)\s*BAR")
    return F.coalesce(F.concat(psi, F.lit("PSI")), F.concat(F.lit("PN"), pn),
                      F.concat(bar, F.lit("BAR")), F.lit(""))


def design_pressure(text: Column) -> Column:
    """PN before PSI before BAR, with decimals; null if absent."""
    pn = first_group(text, r"\bPN\s*(\d+)\b")
    psi = first_group(text, r"\b(\d+(?:\.\d+)?)\s*PSI\b")
    bar = first_group(text, r"\b(\d+(?:\.\d+)?)\s*BAR\b")
    return F.coalesce(F.concat(F.lit("PN"), pn), F.concat(psi, F.lit(" PSI")),
                      F.concat(bar, F.lit(" BAR")))


def design_size(text: Column, connection: Column) -> Column:
    """Size as the connection writes it: outside diameter for grooved ends, DN for flat ends."""
    number = r"((?:\d+\s+\d+/\d+|\d+/\d+|\d+))"
    pair = number + r'\s*"\s*/\s*(?:DN\s*(\d+)|(\d+(?:\.\d+)?)\s*MM)'
    dn_to_od = {k: str(v) for k, v in DESIGN_DN_TO_OD.items()}
    od_to_dn = {v: str(k) for k, v in DESIGN_DN_TO_OD.items()}
    found = F.struct(
        connection.alias("connection"), collapse(first_group(text, pair, 1)).alias("left"),
        plain_int(first_group(text, pair, 2)).alias("pair_dn"),
        first_group(text, pair, 3).alias("pair_od"),
        plain_int(first_group(text, r"\bDN\s*(\d+)\b")).alias("dn"),
        collapse(first_group(text, number + r'\s*"', 1)).alias("inch"))

    def size(inches: Column, mark: str, value: Column, unit: str = "") -> Column:
        return F.concat(inches, F.lit('"/' + mark), value, F.lit(unit))

    def write(f: Column) -> Column:
        flat_dn = F.when(f["connection"].isin("FLANGED", "WAFER", "LUG", "LUG WAFER"), lookup(
            od_to_dn, F.rint(f["pair_od"].try_cast("double")).cast("int")))
        dn_inch = lookup(DESIGN_DN_TO_INCH, f["dn"].try_cast("int"))

        def od_of(value: Column) -> Column:
            return F.when(f["connection"] == "GROOVED", lookup(dn_to_od, value.try_cast("int")))

        return F.coalesce(
            size(f["left"], "", od_of(f["pair_dn"]), "MM"),
            size(f["left"], "DN", f["pair_dn"]), size(f["left"], "DN", flat_dn),
            size(f["left"], "", plain_int(normalize_number(f["pair_od"])), "MM"),
            size(dn_inch, "", od_of(f["dn"]), "MM"), size(dn_inch, "DN", f["dn"]),
            F.concat(F.lit("DN"), f["dn"]), F.concat(f["inch"], F.lit('"')))

    return let(found, write)


def _valid(values: Column) -> Column:
    """Numbers above 0 and up to 2000, without decimal padding."""
    def good(x: Column) -> Column:
        number = x.try_cast(DECIMAL)
        return (number > 0) & (number <= 2000)
    return F.transform(F.filter(values, good), normalize_number)


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _largest(values: Column) -> Column:
    """Numerically largest entry; the first of equals."""
    ranked = F.transform(values, lambda x, i: F.struct(
        x.cast(DECIMAL).alias("number"), (-i).alias("order"), x.alias("text")))
    return F.array_max(ranked)["text"]


def _inches(text: Column) -> Column:
    """``2 1/2``, ``2-1/2``, ``21/2``, ``3/4`` or ``4.5`` as decimal inches."""
    flat = collapse(F.regexp_replace(text, r"\s*-\s*", " "))
    # A numerator of two or more digits, at least 10, hides the whole number in front.
    opened = F.regexp_replace(F.regexp_replace(flat, r"^(0*[1-9]\d*)(\d)/", "$1 $2/"),
                              r"^(?:(\d+) )?(\d+)/(\d+)$", "$1|$2|$3")

    def value(parts: Column) -> Column:
        def number(i: int) -> Column:
            return F.nullif(F.get(parts, F.lit(i)), F.lit("")).try_cast(DECIMAL)
        whole = F.coalesce(number(0), F.lit(0).cast(DECIMAL))
        fraction = (whole + F.try_divide(number(1), number(2))).try_cast(DECIMAL)
        return F.when(F.size(parts) == 3, fraction).otherwise(number(0))

    return let(F.split(opened, r"\|"), value)


def infer_size(description: Column) -> Column:
    """Struct (size, rule, reliability) of a deterministic size, null when it abstains."""
    text = description

    def parsed(values: Column) -> Column:
        return F.filter(F.transform(values, _inches), lambda x: x.isNotNull() & (x > 0))

    quoted = parsed(all_groups(text, INCH_PATTERN))
    copper_inch = parsed(all_groups(text, COPPER_INCH_PATTERN))
    inch = let(quoted, lambda q: F.when(F.size(q) > 0, _last(q)).otherwise(_last(copper_inch)))
    found = F.struct(
        _valid(all_groups(text, DN_PATTERN)).alias("dn"),
        F.transform(_valid(all_groups(text, MM_PATTERN)), lambda x: F.round(
            x.cast(DECIMAL), 0).cast("int").cast("string")).alias("mm"),
        matches(text, GROOVED_PATTERN).alias("grooved"),
        matches(text, SUITABLE_PATTERN).alias("suitable"),
        matches(text, COPPER_PATTERN).alias("copper"),
        F.when(matches(text, GROOVED_PATTERN), inch).alias("inch"),
        *[F.contains(F.upper(text), F.lit(code)).alias(code) for code in GROOVED_PRODUCT_OD])

    def result(size: Column, rule: str) -> Column:
        return F.struct(size.alias("size"), F.lit(rule).alias("rule"),
                        F.lit(SIZE_RULE_RELIABILITY[rule]).alias("reliability"))

    def pipe_diameter(f: Column) -> Column:
        inches = f["inch"].cast("double")
        tube = F.round((f["inch"] + F.lit("0.125").cast(DECIMAL))
                       * F.lit("25.4").cast(DECIMAL), 0).cast("int").cast("string")
        product = [F.when(f[code], lookup(_double_keys(table), inches))
                   for code, table in GROOVED_PRODUCT_OD.items()]
        return F.when(f["copper"], tube).otherwise(F.coalesce(
            *product, lookup(_double_keys(GROOVED_INCH_TO_OD), inches)))

    def pick(f: Column, values: Column) -> Column:
        return F.when(f["suitable"], _largest(values)).otherwise(_last(values))

    def grooved_size(f: Column) -> Column:
        last_mm = _last(f["mm"])
        by_dn = F.filter(F.transform(f["dn"], lambda x: lookup(GROOVED_DN_TO_OD, x)),
                         lambda x: x.isNotNull())
        product = F.lit(False)
        for code in GROOVED_PRODUCT_OD:
            product = product | f[code]

        def with_diameter(od: Column) -> Column:
            close = F.abs(last_mm.try_cast("int") - od.try_cast("int")) <= 3
            return (F.when(close, result(last_mm, "grooved_explicit_mm"))
                    .when(f["copper"], result(od, "grooved_cts_inch_to_od"))
                    .when(product, result(od, "grooved_product_inch_to_od"))
                    .otherwise(result(od, "grooved_inch_to_od")))

        without = F.when(F.size(f["mm"]) == 0, let(by_dn, lambda v: F.when(
            F.size(v) > 0, result(pick(f, v), "grooved_dn_to_od"))))
        return let(pipe_diameter(f), lambda od: F.when(
            od.isNotNull(), with_diameter(od)).otherwise(without))

    def plain_size(f: Column) -> Column:
        has_mm, has_dn = F.size(f["mm"]) > 0, F.size(f["dn"]) > 0
        return (F.when(has_mm & f["suitable"], result(_largest(f["mm"]), "suitable_range_max"))
                .when(has_mm, result(_last(f["mm"]), "explicit_mm"))
                .when(has_dn & f["suitable"], result(_largest(f["dn"]), "suitable_range_max"))
                .when(has_dn, result(_last(f["dn"]), "dn_size")))

    return let(found, lambda f: F.when(f["grooved"], grooved_size(f)).otherwise(plain_size(f)))


def size_candidates(description: Column) -> Column:
    """Sorted distinct DN and millimetre numbers of a text."""
    values = F.concat(all_groups(description, DN_PATTERN), all_groups(description, MM_PATTERN))
    return F.array_sort(F.array_distinct(F.transform(values, normalize_number)))
