"""Product codes, specifications, stable ids and model decoding as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, first_group, let, normalize_code, strip

SPEC_PATTERN = r"^([A-Z]+)([0-9]+(?:\.[0-9]+)?)$"
# The size of a standard specification without decimal padding.
SPEC_SIZE = r"^[A-Z]+([0-9]+(?:\.[0-9]*[1-9])?)\.?0*$"


def normalize_number(value: Column) -> Column:
    """Drop decimal padding, keep integer zeroes."""
    trimmed = F.regexp_replace(F.regexp_replace(value, r"0+$", ""), r"\.$", "")
    return F.when(F.contains(value, F.lit(".")), trimmed).otherwise(value)


def parse_spec(spec: Column) -> Column:
    """Struct (prefix, size) of a standard specification, null otherwise."""
    return parse_normalized_spec(normalize_code(spec))


def parse_normalized_spec(code: Column) -> Column:
    """The same of a column that normalize_code has made."""
    return F.when(
        code.rlike(SPEC_PATTERN),
        F.struct(F.regexp_extract(code, SPEC_PATTERN, 1).alias("prefix"),
                 F.regexp_extract(code, SPEC_SIZE, 1).alias("size")))


def spec_number(spec: Column) -> Column:
    return normalize_number(first_group(spec, SPEC_PATTERN, 2))


def is_nonstandard_spec(spec: Column) -> Column:
    """First character not a letter, or rest not all digits."""
    return ~spec.rlike(r"^\p{L}\p{Nd}+$")


def parse_product_code(code: Column, by1: Column, spec: Column, material: Column) -> Column:
    """Struct of the segments of ``<prefix><by1>_<spec>_<form><material><surface>``.

    Every step is bound once, so filters on the result stay small when they are pushed down.
    """
    return parse_normalized_code(*map(normalize_code, (code, by1, spec, material)))


def parse_normalized_code(code: Column, by1: Column, spec: Column, material: Column) -> Column:
    """The same of columns that normalize_code has made; string searches only.

    The first segment that equals the specification is the one, unless nothing stands before or
    behind it; without a specification it is the first that is not empty, behind underscores.
    """
    none = F.lit("")
    segment = F.when(spec == "", F.regexp_extract(code, r"^_+([^_]+)_", 1)).otherwise(spec)
    inputs = F.struct(code.alias("raw"), by1.alias("by1"), material.alias("mat"),
                      segment.alias("spec"))

    def locate(i: Column) -> Column:
        unfit = (i["spec"] == "") | F.contains(i["spec"], F.lit("_")) | F.startswith(
            i["raw"], F.concat(i["spec"], F.lit("_")))
        at = F.when(unfit, 0).otherwise(
            F.position(F.concat(F.lit("_"), i["spec"], F.lit("_")), i["raw"]))
        return let(at, lambda p: cut_up(i, p))

    def cut_up(i: Column, p: Column) -> Column:
        segments = F.struct(
            (p > 0).alias("found"),
            F.when(p > 0, F.left(i["raw"], p - 1)).otherwise(none).alias("head"),
            F.when(p > 0, F.substring(i["raw"], p + F.length(i["spec"]) + 2, F.length(i["raw"])))
            .otherwise(none).alias("tail"))
        return let(segments, lambda s: split_tail(i, s))

    def split_tail(i: Column, s: Column) -> Column:
        cut = F.when(i["mat"] != "", F.position(i["mat"], s["tail"])).otherwise(0)
        ends = (i["by1"] != "") & F.endswith(s["head"], i["by1"])

        def finish(x: Column) -> Column:
            form = F.when(x["cut"] > 0, F.btrim(
                F.left(s["tail"], x["cut"] - 1), F.lit("_"))).otherwise(none)
            surface = F.when(x["cut"] > 0, F.btrim(F.substring(
                s["tail"], x["cut"] + F.length(i["mat"]), F.length(s["tail"])), F.lit("_"))
            ).otherwise(none)
            single = F.length(s["head"]) - F.length(i["by1"]) == 1
            prefix = F.when(x["ends"] & single, F.left(s["head"], F.lit(1))).otherwise(none)
            return let(F.struct(form.alias("form"), prefix.alias("prefix")), lambda y: F.struct(
                i["raw"].alias("raw_code"), s["head"].alias("code_by1"),
                y["prefix"].alias("business_prefix"),
                F.when(s["found"], i["spec"]).otherwise(none).alias("specification"),
                y["form"].alias("form_code"),
                F.when(x["cut"] > 0, i["mat"]).otherwise(none).alias("material"),
                surface.alias("surface"),
                F.when(i["raw"] == "", "missing_code")
                .when(~s["found"], "spec_segment_not_found")
                .when(x["cut"] == 0, "material_not_found").when(~x["ends"], "by1_mismatch")
                .when(y["form"] == "", "empty_form_code")
                .when((s["head"] != i["by1"]) & (y["prefix"] == ""), "business_prefix_missing")
                .otherwise("ok").alias("status")))

        return let(F.struct(cut.alias("cut"), ends.alias("ends")), finish)

    return let(inputs, locate)


# RFC 4122 namespaces for DNS names and URLs.
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(
        F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))
        .bitwiseOR(F.lit(0x80))))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def parent_id(product: Column, text: Column | None = None) -> Column:
    """Stable id of a product; a given text adds its first 50 characters."""
    if text is None:
        return uuid5(NAMESPACE_DNS, product)
    extended = F.concat(product, F.lit("_"), F.substring(text, 1, 50))
    return uuid5(NAMESPACE_DNS, F.when(blank(text) == "", product).otherwise(extended))


def child_id(parent: Column, index: Column) -> Column:
    return uuid5(NAMESPACE_DNS, F.concat(parent, F.lit("_chunk_"), index.cast("string")))


def record_id(by1: Column, form: Column, spec: Column, description: Column) -> Column:
    return uuid5(NAMESPACE_URL, F.concat_ws("|", *map(blank, (by1, form, spec, description))))


def template_point_id(template_id: Column) -> Column:
    return uuid5(NAMESPACE_URL, F.concat(F.lit("edesc-template:"), template_id))


def cluster_template_id(by1: Column, signature: Column, cluster_id: Column) -> Column:
    digest = F.sha1(F.encode(F.concat_ws("|", by1, signature, cluster_id.cast("string")), "UTF-8"))
    return F.concat(F.lit("tpl-"), F.upper(F.substring(digest, 1, 12)))


def design_template_id(family: Column, values: Column) -> Column:
    """Id of a family and its ``field=value`` pairs; size takes no part."""
    fields = F.array_sort(F.filter(F.map_keys(values), lambda k: k != "size"))
    signature = F.array_join(
        F.transform(fields, lambda k: F.concat(k, F.lit("="), F.element_at(values, k))), "|")
    digest = F.sha1(F.encode(F.concat_ws("|", family, signature), "UTF-8"))
    return F.concat(F.upper(F.substring(family, 1, 3)), F.lit("-"),
                    F.upper(F.substring(digest, 1, 10)))


def versioned_name(base: str, version: str) -> str:
    """Physical table name of a version; only letters and digits of the version count."""
    safe = "".join(c if c.isascii() and c.isalnum() else " " for c in version)
    safe = "_".join(safe.split()).lower()
    if not safe:
        raise ValueError("version must contain letters or digits")
    return f"{base}_{safe}"


# Valve model code tables.
TYPE_TWO = {"XZ": "闸阀(带信号装置)", "XD": "蝶阀(带信号装置)", "DH": "蝶式止回阀",
            "IP": "指示器系列", "WP": "指示器系列"}
TYPE_ONE = {"Z": "闸阀", "J": "截止阀", "L": "节流阀", "Q": "球阀", "D": "蝶阀",
            "A": "弹簧式安全阀", "R": "杠杆式安全阀", "Y": "减压阀", "S": "疏水阀",
            "H": "止回阀/底阀", "P": "排污阀", "G": "隔膜阀", "U": "柱塞阀", "X": "旋塞阀",
            "V": "过滤器"}
ACTUATION = {"0": "电磁", "1": "电磁液动", "2": "电液动", "3": "蜗轮", "4": "正齿轮",
             "5": "伞齿轮", "6": "气动", "7": "液动", "8": "气液联动", "9": "电动"}
CONNECTION = {"1": "内螺纹", "2": "外螺纹", "3": "机械接头", "4": "法兰", "5": "法兰+卡箍",
              "6": "焊接", "7": "对夹式", "8": "卡箍", "9": "卡套", "0": "法兰+机械"}
STRUCTURE = {
    "Z": {"0": "弹性闸板", "1": "明杆楔式单闸板", "2": "明杆楔式双闸板", "3": "明杆平行单闸板",
          "4": "明杆平行双闸板", "5": "暗杆楔式单闸板", "6": "暗杆楔式双闸板",
          "7": "暗杆平行单闸板", "8": "暗杆平行双闸板"},
    "D": {"0": "单偏心(密闭型)", "1": "中心垂直板(密闭型)", "2": "双偏心(密闭型)",
          "3": "三偏心(密闭型)", "4": "连杆机构(密闭型)", "5": "单偏心(非密闭型)",
          "6": "中心垂直板(非密闭型)", "7": "双偏心(非密闭型)", "8": "三偏心(非密闭型)",
          "9": "连杆机构(非密闭型)"},
    "H": {"1": "升降式-直通流", "2": "升降式-立式", "3": "升降式-角式流", "4": "旋启式-单瓣",
          "5": "旋启式-多瓣", "6": "旋启式-双瓣", "7": "旋启式-蝶形止回"},
}
STRUCTURE_FAMILY = {"Z": "Z", "XZ": "Z", "D": "D", "XD": "D", "H": "H", "DH": "H"}
SEAL = {"J": "橡胶(衬胶常见)", "X": "橡胶", "F": "PTFE", "S": "塑料", "N": "尼龙"}
BODY_MATERIAL_CODES = "BNFHJMPRSTXYCDGQ"
NO_ACTUATION_TYPES = ["A", "R", "Y", "S"]


def lookup(table: dict, key: Column) -> Column:
    """Value of a fixed table for a key column, null when absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def decode_model(model: Column) -> Column:
    """Struct of a valve model: decoded fields, standard product and a status."""
    m = f"[{BODY_MATERIAL_CODES}]"
    types = "|".join([*TYPE_TWO, *TYPE_ONE])

    def find_type(text: Column) -> Column:
        clean = F.regexp_replace(F.upper(text), r"[^A-Za-z0-9]+", "")
        base = F.when(clean.rlike(f"^(?:{types})"), clean).otherwise(
            F.substring(clean, F.lit(2), F.length(clean)))
        return let(base, lambda b: let(F.regexp_extract(b, f"^({types})", 1), lambda kind: cut_body(
            text, kind, F.substring(b, F.length(kind) + 1, F.length(b)))))

    def cut_body(text: Column, kind: Column, body: Column) -> Column:
        # Up to the first material letter behind a digit, else up to the last material letter.
        standard = F.coalesce(first_group(body, f"^(.*?[0-9]{m})"), first_group(body, f"^(.*{m})"),
                              F.lit(""))
        status = (F.when(text == "", "empty").when(kind == "", "unknown_type")
                  .when(standard == "", "material_not_found")
                  .otherwise("ok"))
        return let(F.struct(kind.alias("kind"), standard.alias("body"), status.alias("status")),
                   decode)

    def decode(x: Column) -> Column:
        core = F.substring(x["body"], F.lit(1), F.length(x["body"]) - 1)
        may_act = ~x["kind"].isin(NO_ACTUATION_TYPES)
        driven = may_act & core.rlike("^[0-9]{3}")
        by_hand = may_act & ~driven & core.rlike("^[0-9]{2}")
        rest = F.when(driven, F.substring(core, F.lit(2), F.length(core))).otherwise(core)
        digit = F.regexp_extract(rest, "^.([0-9])", 1)
        family = lookup(STRUCTURE_FAMILY, x["kind"])
        structure = F.coalesce(*[F.when(family == name, lookup(table, digit))
                                 for name, table in STRUCTURE.items()])
        ok = x["status"] == "ok"
        return F.struct(
            F.when(ok, lookup({**TYPE_ONE, **TYPE_TWO}, x["kind"])).alias("type"),
            F.when(ok & driven, lookup(ACTUATION, F.left(core, F.lit(1))))
            .when(ok & by_hand, F.lit("手动驱动")).alias("driveMode"),
            F.when(ok, lookup(CONNECTION, F.left(rest, F.lit(1)))).alias("connectMode"),
            F.when(ok, structure).alias("form"),
            F.when(ok, lookup(SEAL, F.right(x["body"], F.lit(1)))).alias("material"),
            F.when(ok, F.concat(x["kind"], x["body"])).alias("standardizedProduct"),
            x["status"].alias("status"))

    return let(strip(blank(model)), find_type)
