"""Description standardiser: cleaned text, features, seven segments and attribute views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import nominal_size, pressure
from .text import all_groups, blank, collapse, first_group, has, matches, rx, strip, sub

# Spelling fixes, in order.
SPELLING = [("ENCENTRIC", "ECCENTRIC"), ("THEREADED", "THREADED"),
            ("WAFER BUTTERF.V.", "WAFER BFV"), ("BUNA-N", "NBR")]
# Words split off from a glued neighbour; "before" splits in front of the word,
# "after" behind it. The order is part of the meaning.
GLUED = [("before", "FIRE"), ("after", "FIRE"), ("before", "RISER"), ("after", "RISER"),
         ("before", "WAFER"), ("after", "WAFER"), ("before", "GROOVED"), ("before", "GRVD"),
         ("before", "LUG"), ("after", "LUG"), ("before", "FLANGE"), ("after", "FLANGE"),
         ("before", "THREADED"), ("before", "DISC"), ("before", "SEAT"), ("before", "EPDM"),
         ("after", "EPDM"), ("before", "LEVER"), ("before", "GEAR"), ("after", "GEAR"),
         ("before", "SWITCH"), ("after", "SWITCH"), ("before", "TAMPER"),
         ("before", "BUTTERFLY"), ("after", "BUTTERFLY")]

# Feature words.
STRONG_SIGNAL = ["FIRE RISER", "TAMPER SWITCH", "W/SWITCHES", "W/ SWITCHES", "FLYING LEAD",
                 "NORMAL CLOSE", "BVW-", "BVT-", "GBV-", "BFV-", "D48638", "FIG 215", "FIG 216",
                 "SPF", "GEAR-OP", "NEW TURBINE"]
WEAK_SIGNAL = ["BVG-", "UL/FM", "UL FM", "FM UL", "UL ", " FM "]
NO_DRIVE_WORDS = ["NO DRIVE", "WITHOUT GEAR BOX", "BARE", "NO HANDLE", "WITHOUT DRIVER"]
GEAR_WORDS = ["GEAR", "TURBINE", "W/HWHEEL", "H/WHEEL", "HANDWHEEL"]

# Extra attributes looked for in the text, in output order.
EXTRA_PATTERNS = [
    r"SS316\s*STEM", r"416\s*SS\s*STEM", r"SS304\s*STEM", r"SS316\s*BOLT\s*&\s*NUT",
    r"SS316\s*BOLT", r"STAINLESS\s*STEM", r"SS316\s*SHAFT",
    r"\b608[DLF]?E?\b", r"\b808[DLF]?E?\b", r"\b608L\b", r"\bST-700\w*\b",
    r"\bBV[GWL]-[\w-]+\b", r"\bHDM\w+\b", r"\bHD\d{3}\b", r"\bGBV-\d+\b", r"\bBFV-[\w-]+\b",
    r"\bBVL-\w+\b", r"\bLD\d+\w*\b", r"\bFIG\s*\d+\b",
    r"\bAWWA\b", r"\bUL\s*LISTED\b", r"\bFM\s*APPROV\w*\b", r"\bJIS\s*\d+\w*\b", r"\bANSI\b",
    r"\bASME\b",
    r"\bMICROSWITCH\b", r"\bPOSITION\s*INDICATOR\b", r"\bNORMAL\s*CLOSE\b",
    r"\bFLYING\s*LEAD\b", r"\bSUPERVISORY\b", r"\bNC\b",
    r"\bO-RING\b", r"\bRESILIENT\b", r"\bLIP\s*SEAL\b", r"\bEPDM\s*SEAL\b",
    r"\bRAL\s*\d+\b", r"\bGALVANIZED\b", r"\bEPOXY\s*COAT\w*\b", r"\bBLUE\b", r"\bRED\b",
    r"\bB&N\b", r"\bSALZGITTER\b", r"\bSPF\b", r"\bTYCO\b", r"\bAVCON\b", r"\bWATTS\b",
    r"\bVAG\b",
    r"\b\d+M\s*CABLE\b", r"\b\d+M\s*FLYING\s*LEAD\b", r"\bEXTERNAL\b", r"\bFIXTURE\b",
    r"\bACCESSOR\w+\b", r"\bHOLDER\b", r"\bCATALOG\w*\b", r"\bSERIES\s*\d+\b", r"\bCL\s*\d+\b",
    r"\b\d+OD\b",
]
# Wording already held by the other segments, removed in this order.
COVERED_PATTERNS = [
    r"\bUL\b\s*/?\s*\bFM\b", r"\bUL\b", r"\bFM\b", r"\bUL/FM\b",
    r"\bDI\b", r"\bDUCTILE\s*IRON\b", r"\bDUCTILE\b",
    r"\bWAFER\b", r"\bLUG(?:GED)?\b", r"\bGRVD\b", r"\bGROOVED\b", r"\bGRV\b",
    r"\bFLGD\b", r"\bFLANGED?\b", r"\bFLG\b", r"\bTHD\b", r"\bTHREADED\b",
    r"\bBUTTERFLY\b", r"\bBFV\b", r"\bBV\b", r"\bBFLY\b", r"\bVALVE\b", r"\bBF\b",
    r"\bDOUBLE\s*ECCENTRIC\b", r"\bTRIPLE\s*ECCENTRIC\b", r"\bECCENTRIC\b", r"\bENCENTRIC\b",
    r"\bTAMPER\b", r"\bSWITCH(?:ES)?\b", r"\bW/\b", r"\bC/W\b", r"\bFIRE\b", r"\bRISER\b",
    r"\bSUPERVISORY\b", r"\bSPF\b",
    r"\bEPDM\b", r"\bNBR\b", r"\bVITON\b", r"\bVTON\b", r"\bPTFE\b", r"\bTEFLON\b",
    r"\bSEAT\b", r"\bBUNA\b", r"\bNITRILE\b",
    r"\bSS\s*316\b", r"\bSS\s*304\b", r"\b316\s*SS\b", r"\b304\s*SS\b",
    r"\bDI\+EPDM\b", r"\bDI\+NBR\b", r"\bDI\s*DISC\b", r"\bCS\s*DISC\b",
    r"\bDISC\b", r"\bDISK\b", r"\bSS316\b", r"\bSS304\b", r"\+HOLDER\b", r"\bHOLDER\b",
    r"\bLEVER\b", r"\bGEAR\b", r"\bGEARBOX\b", r"\bWORM\b", r"\bHANDLE\b",
    r"\bMOTORIZED\b", r"\bACTUAT\w*\b", r"\bBARE\b", r"\bBARE\s*SHAFT\b",
    r"\bHIGHER\b", r"\bLOCKABLE\b", r"\bLONG\s*NECK\b", r"\bNO\s*DRIVE\b",
    r"\bWITHOUT\s*GEAR\s*BOX\b", r"\bOP\b", r"\bOPERATED\b", r"\bTURBINE\b",
    r"\bHANDWHEEL\b",
    r'\d+(?:\s+\d+/\d+)?\s*"[^,)]*(?:DN\d+)?[\d\sMM]*',
    r"\bDN\d+\b", r"\d+(?:\.\d+)?\s*MM\b", r"\b\d+OD\b",
    r"\d+\s*PSI", r"\bPN\d+\b", r"\d+\s*BAR",
    r"\bWITH\b", r"\bAND\b", r"\bTYPE\b", r"\bINCH\b", r"\bBODY\b", r"\bIRON\b", r"\bTHE\b",
]


def preprocess(text: Column) -> Column:
    """Upper case, spelling fixes, glued words split, white space collapsed."""
    out = F.upper(blank(text))
    for wrong, right in SPELLING:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    for side, word in GLUED:
        pattern = rf"(\w)({word})" if side == "before" else rf"({word})(\w)"
        out = sub(out, pattern, "$1 $2")
    return collapse(out)


def _choice(*cases: tuple[Column, str], default: str = "UNKNOWN") -> Column:
    first, *rest = cases
    out = F.when(first[0], F.lit(first[1]))
    for condition, value in rest:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def features(t: Column) -> Column:
    """Struct of features of a preprocessed text."""
    strong = has(t, *STRONG_SIGNAL)
    lug = t.contains("LUG")
    wafer = has(t, "WAFER", "WAF ", "WAF.")
    grooved = has(t, "GRVD", "GRV", "GROOVE", "GR BFV", "GR BV")
    flanged = has(t, "FLGD", "FLANGE")
    connection = _choice(
        (has(t, "THREADED", "THD", "BSP", "NPT"), "THREADED"), (flanged, "FLANGED"),
        (grooved, "GROOVED"), (lug & wafer, "LUG_WAFER"), (lug, "LUG"), (wafer, "WAFER"))
    structure = _choice(
        (has(t, "TRIPLE ECCENTRIC", "3 ECCENTRIC", "3 ENCENTRIC"), "3"),
        (has(t, "DOUBLE ECCENTRIC", "HIGH PERFORMANCE"), "2"), default="1")
    seat = _choice(
        (has(t, "PTFE", "TEFLON", "T SEAL"), "PTFE"), (t.contains("CS SEAT"), "CS"),
        (t.contains("NBR"), "NBR"), (t.contains("EPDM"), "EPDM"),
        (has(t, "VITON", "VTON"), "VITON"))
    seat_code = (F.when(seat == "PTFE", "F").when(seat == "CS", "H")
                 .when(seat == "UNKNOWN", "UNKNOWN").otherwise("X"))
    actuation = _choice(
        (has(t, *NO_DRIVE_WORDS), "NO_DRIVE"), (t.contains("LEVER"), "LEVER"),
        (has(t, *GEAR_WORDS), "GEAR"), (has(t, "MOTORIZED", "ACTUATOR"), "MOTORIZED"))
    disc = _choice(
        (matches(t, r"316\s*DISC"), "SS316"), (matches(t, r"304\s*DISC"), "SS304"),
        (has(t, "DI+EPDM DISC", "DI EPDM DISC"), "DI_EPDM"), (t.contains("DI+NBR DISC"), "DI_NBR"),
        (t.contains("CS DISC"), "CS"), (matches(t, r"DI\s*DISC|DUCTILE\s*DISC"), "DI"))
    inch_dn = r'(\d+(?:\.\d+)?)\s*"/DN(\d+)'
    inch_mm = r"(\d+(?:\.\d+)?)\s*/(\d+)MM"
    with_dn, with_mm = matches(t, inch_dn), matches(t, inch_mm)
    return F.struct(
        (strong | matches(t, r"\bXD\d{3}[XFH]")).alias("has_signal"),
        (has(t, *WEAK_SIGNAL) & ~strong).alias("has_signal_weak"),
        connection.alias("connection"), lug.alias("has_lug"), wafer.alias("has_wafer"),
        grooved.alias("has_grooved"), flanged.alias("has_flanged"),
        structure.alias("valve_structure"), seat_code.alias("seat_material"),
        seat.alias("seat_name"), actuation.alias("actuation"), disc.alias("disc_material"),
        t.contains("LONG NECK").alias("is_long_neck"),
        has(t, "LOCKABLE", "INFINITE").alias("is_lockable"),
        t.contains("HIGHER LEVER").alias("is_higher_lever"),
        has(t, "AL HANDLE", "ALUMINUM").alias("has_al_handle"),
        t.contains("CS LEVER").alias("has_cs_lever"),
        t.contains("NORMAL CLOSE").alias("has_normal_close"),
        t.contains("NEW TURBINE").alias("has_new_turbine"),
        has(t, "JIS", "JSI").alias("has_jis"),
        F.replace(t, F.lit(" "), F.lit("")).contains("300PSI").alias("has_300psi"),
        t.contains("AWWA").alias("has_awwa"), t.contains("70G").alias("has_70g"),
        F.when(with_dn, first_group(t, inch_dn, 1).try_cast("double"))
        .when(with_mm, first_group(t, inch_mm, 1).try_cast("double")).alias("size_inch"),
        F.when(with_dn, first_group(t, inch_dn, 2).try_cast("bigint"))
        .when(~with_mm, first_group(t, r"DN(\d+)").try_cast("bigint")).alias("size_dn"),
    )


def _words(*parts: Column) -> Column:
    """Join with one blank, leaving out nulls."""
    return F.concat_ws(" ", *parts)


def _named(value: Column, table: dict) -> Column:
    out = None
    for key, text in table.items():
        out = F.when(value == key, text) if out is None else out.when(value == key, text)
    return out


def body_segment(f: Column) -> Column:
    connection = _named(f["connection"], {
        "WAFER": "WAFER", "LUG_WAFER": "LUG WAFER", "LUG": "LUG", "GROOVED": "GRVD",
        "FLANGED": "FLGD", "THREADED": "THD"})
    return _words(
        F.when(f["has_signal"] | f["has_signal_weak"], "UL/FM"), F.lit("DI"), connection,
        F.lit("BFV"), _named(f["valve_structure"], {"2": "DOUBLE ECCENTRIC",
                                                    "3": "TRIPLE ECCENTRIC"}),
        F.when(f["has_signal"], "W/TAMPER SWITCH"))


def seat_segment(f: Column) -> Column:
    return F.when(f["seat_name"] != "UNKNOWN", F.concat(f["seat_name"], F.lit(" SEAT"))).otherwise("")


def disc_segment(f: Column) -> Column:
    return F.coalesce(_named(f["disc_material"], {
        "SS316": "SS316 DISC", "SS304": "SS304 DISC", "DI_EPDM": "DI+EPDM DISC",
        "DI_NBR": "DI+NBR DISC", "DI": "DI DISC", "CS": "CS DISC"}), F.lit(""))


def actuation_segment(f: Column) -> Column:
    return _words(
        _named(f["actuation"], {"GEAR": "GEAR", "LEVER": "LEVER", "MOTORIZED": "MOTORIZED",
                                "NO_DRIVE": "BARE SHAFT"}),
        F.when(f["is_higher_lever"], "HIGHER"), F.when(f["is_lockable"], "LOCKABLE"),
        F.when(f["is_long_neck"], "LONG NECK"))


def extra_segment(upper: Column) -> Column:
    """Known extra attributes, then words no other segment covers, each once."""
    found = F.flatten(F.array(*[all_groups(upper, p, 0) for p in EXTRA_PATTERNS]))
    extras = F.filter(F.transform(found, strip), lambda x: x != "")
    rest = reduce(lambda text, p: sub(text, p, " "), COVERED_PATTERNS, upper)
    words = F.split(collapse(sub(rest, r"[,.\-/]+\s*", " ")), " ")
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike(rx(r"^\d+$")))
    return F.array_join(F.array_distinct(F.concat(extras, kept)), " ")


SEGMENTS = ["body", "seat", "disc", "actuation", "size", "pressure", "extra"]
VALVE_WORDS = r"\b(?:BFV|BV|BUTTERFLY|VALVE|CHECK)\b"


def _joined(names: list[str]) -> Column:
    return F.concat_ws(",", *[F.nullif(F.col(n), F.lit("")) for n in names])


def with_features(df: DataFrame, text: str) -> DataFrame:
    """Adds clean_text and features of a description column."""
    return df.withColumn("clean_text", preprocess(F.col(text))).withColumn(
        "features", features(F.col("clean_text")))


def with_segments(df: DataFrame, text: str) -> DataFrame:
    """Adds clean_text, features, the seven segments and both joined texts."""
    f = F.col("features")
    staged = with_features(df, text).withColumn("_upper", F.upper(blank(F.col(text))))
    staged = staged.withColumns({
        "body": body_segment(f), "seat": seat_segment(f), "disc": disc_segment(f),
        "actuation": actuation_segment(f), "size": nominal_size(F.col("_upper")),
        "pressure": pressure(F.col("_upper")), "extra": extra_segment(F.col("_upper")),
    }).drop("_upper")
    clean = F.col("clean_text")
    other = sub(sub(sub(clean, r"\bDN\s*\d+(?:\.\d+)?\b", " "), r"\b\d+(?:\.\d+)?\s*MM\b", " "),
                r'\b\d+(?:\s+\d+/\d+)?\s*"', " ")
    other = F.trim(F.regexp_replace(other, r"[^\p{L}\p{N}]+", " "))
    return staged.withColumns({
        "standardized": _joined(SEGMENTS),
        "semantic_text": F.when(matches(clean, VALVE_WORDS),
                                _joined([s for s in SEGMENTS if s != "size"])).otherwise(other),
    })


EVIDENCE_TYPE = "struct<value:string,source:string,confidence:double,evidence:string>"


def evidence(value: Column, proof: Column, source: str = "query") -> Column:
    return F.struct(value.alias("value"), F.lit(source).alias("source"),
                    F.lit(1.0).alias("confidence"), proof.alias("evidence"))


def with_views(df: DataFrame, text: str) -> DataFrame:
    """Adds normalized / structural / full views and a map of observed attributes."""
    staged = with_segments(df, text)
    clean, f = F.col("clean_text"), F.col("features")
    body = (F.when(clean.contains("DUCTILE IRON"), "DI").when(clean.contains("CAST IRON"), "CI")
            .when(clean.contains("CARBON STEEL"), "CS").when(clean.contains("SS316"), "SS316")
            .when(clean.contains("SS304"), "SS304"))
    connection = F.when(f["connection"] != "UNKNOWN", F.replace(
        f["connection"], F.lit("_"), F.lit(" ")))
    family = (F.when(matches(clean, r"\b(?:BFV|BUTTERFLY)\b"), "butterfly")
              .when(matches(clean, r"\b(?:CHECK|NRV)\b"), "check")
              .when(matches(clean, r"\b(?:GATE|GV)\b"), "gate"))
    entries = [
        ("body_material", body, body), ("connection", connection, connection),
        ("seat_material", f["seat_name"], F.col("seat")),
        ("closure_material", f["disc_material"], F.col("disc")),
        ("actuation", f["actuation"], F.col("actuation")),
        ("pressure", F.col("pressure"), F.col("pressure")),
        ("size", F.col("size"), F.col("size")), ("family", family, family),
    ]
    pairs = [F.struct(F.lit(name).alias("key"),
                      evidence(F.upper(strip(blank(value))), strip(blank(proof))).alias("value"))
             for name, value, proof in entries]
    kept = F.filter(F.array(*pairs),
                    lambda e: ~e["value"]["value"].isin("", "UNKNOWN", "NONE", "NAN"))
    return staged.withColumns({
        "normalized_view": clean, "structural_view": F.col("semantic_text"),
        "full_view": F.when(F.col("standardized") != "", F.col("standardized")).otherwise(clean),
        "attributes": F.map_from_entries(kept),
    })
