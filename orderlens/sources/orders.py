"""Order rows: schema checks, the shared order view, time windows and prepared columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from ..functions.codes import parse_normalized_code, parse_normalized_spec
from ..functions.text import blank, fingerprint, normalize_code, normalize_text, safe_date, strip
from ..plans.scale import slices_for

ORDER_COLUMNS = ["contract_date", "order_no", "product_code", "by1", "spec", "material",
                 "description", "customer"]
TRAIN_BEFORE, VALIDATION_BEFORE = "1999-01-01", "2000-07-01"

# More partitions than any frame has: a coalesce to so many keeps them all.
UNLIMITED = 1_000_000
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
ORDER_HISTORY_SQL = """
SELECT row_id,
  CAST(o_orderdate AS DATE) AS contract_date,
  CAST(o_orderkey AS VARCHAR(20)) AS order_no,
  c_name AS customer,
  by1, spec, material, description,
  CASE WHEN l_linenumber = 7 THEN CAST(30000000000 + p_partkey AS VARCHAR(20))
       ELSE concat(biz, by1, '_', spec, '_', form, material, 'R', CAST(l_linenumber * 10 AS VARCHAR(4))) END AS product_code
FROM (
 SELECT row_id, l_linenumber, o_orderkey, o_orderdate, c_name, p_partkey, fam, biz, dn, form,
  concat(CASE fam WHEN 0 THEN 'XD' WHEN 1 THEN 'H' WHEN 2 THEN 'Z' ELSE 'Q' END, substr(p_brand, 7), 'X') AS by1,
  concat(substr(p_type, 1, 1), dn) AS spec,
  concat('Q', CAST(10 + p_partkey % 7 AS VARCHAR(4))) AS material,
  concat('DI ',
    CASE conn WHEN 0 THEN 'WAFER' WHEN 1 THEN 'LUG WAFER' WHEN 2 THEN 'GROOVED' WHEN 3 THEN 'FLGD' WHEN 4 THEN 'THD' ELSE 'LUG' END, ' ',
    CASE fam WHEN 0 THEN 'BFV' WHEN 1 THEN 'SWING CHECK VALVE' WHEN 2 THEN 'OS&Y GATE VALVE' ELSE 'BALL VALVE' END,
    CASE p_partkey % 3 WHEN 0 THEN ', EPDM SEAT' WHEN 1 THEN ', BUNA-N SEAT' ELSE '' END,
    CASE p_partkey % 5 WHEN 0 THEN ', SS316 DISC' WHEN 1 THEN ', DI DISC' ELSE '' END,
    CASE p_size % 3 WHEN 0 THEN ', GEAR' WHEN 1 THEN ', LEVER' ELSE '' END,
    CASE p_size % 2 WHEN 0 THEN ', PN16' ELSE ', 200PSI' END,
    CASE WHEN l_linenumber IN (1, 2, 3) THEN concat(', DN', dn) WHEN l_linenumber IN (4, 5) THEN concat(', ', dn, 'MM') ELSE '' END,
    CASE WHEN l_linenumber = 3 AND o_orderdate >= DATE '2000-07-01' THEN ', LOCKABLE' ELSE '' END) AS description
 FROM (
  SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(4)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-', CAST(CAST(l_quantity AS INT) AS VARCHAR(8))) AS row_id,
   l_linenumber, o_orderkey, o_orderdate, c_name, p_partkey, p_brand, p_type, p_size,
   p_partkey % 4 AS fam, p_size % 6 AS conn,
   substr('ABCDEFGH', CAST(l_suppkey % 8 AS INT) + 1, 1) AS biz,
   concat('F', substr(p_brand, 7), 'S', CAST(p_size AS VARCHAR(4))) AS form,
   CASE p_size % 9 WHEN 0 THEN '50' WHEN 1 THEN '65' WHEN 2 THEN '80' WHEN 3 THEN '100' WHEN 4 THEN '125' WHEN 5 THEN '150' WHEN 6 THEN '200' WHEN 7 THEN '250' ELSE '300' END AS dn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey) a) b
"""

# The same order lines in the wordings and codes that the plain view leaves out: every notation of
# a size, accessories and spare parts, damaged product codes, and varieties (ending in P) whose
# specification always is one letter and the size that the text gives.
ORDER_VARIANTS_SQL = """
SELECT row_id, contract_date, order_no, customer, by1, material, description,
  CASE WHEN p_partkey % 3 <> 0 AND shape % 13 = 11 THEN concat(letter, size, 'A') ELSE concat(letter, size) END AS spec,
  CASE code WHEN 0 THEN '' WHEN 1 THEN CAST(30000000000 + p_partkey AS VARCHAR(20))
    WHEN 2 THEN concat(biz, by1, '_', letter, size, '_', form, 'ZZ')
    WHEN 3 THEN concat(biz, 'ANOTHER_', letter, size, '_', form, material)
    WHEN 4 THEN concat(biz, by1, '_', letter, size, '_', material, 'R10')
    WHEN 5 THEN concat(biz, biz, by1, '_', letter, size, '_', form, material)
    ELSE concat(CASE WHEN code < 9 THEN '' ELSE biz END, by1, '_', letter, size, '_', form, material, 'R', CAST(p_size AS VARCHAR(4))) END AS product_code
FROM (
 SELECT row_id, contract_date, order_no, customer, p_partkey, p_size, shape, code, biz, form, material,
  CASE WHEN p_partkey % 3 = 0 THEN concat('D', CAST(371 + p_size % 4 AS VARCHAR(4)), 'P')
       ELSE concat(CASE p_partkey % 4 WHEN 0 THEN 'XD' WHEN 1 THEN 'H' WHEN 2 THEN 'Z' ELSE 'Q' END, substr(p_brand, 7), 'X') END AS by1,
  CASE WHEN p_partkey % 3 = 0 THEN substr('ABCD', CAST(p_size % 4 AS INT) + 1, 1) ELSE substr(p_type, 1, 1) END AS letter,
  CASE WHEN shape IN (0, 1, 2, 6, 9, 22) THEN od WHEN shape IN (3, 4) THEN tube
       WHEN shape = 5 THEN CASE dn WHEN '65' THEN '73' WHEN '125' THEN '141' ELSE od END ELSE dn END AS size,
  CASE shape
   WHEN 0 THEN concat('DI GROOVED BFV, EPDM SEAT, GEAR, ', inch, '", 300PSI')
   WHEN 1 THEN concat('di grvd bfv ', inch, '" ', od, 'mm, PN16, ul/fm')
   WHEN 2 THEN concat('GRV BFV ', inch, '"/999MM, W/ SWITCHES')
   WHEN 3 THEN concat('GROOVED CTS BFV ', inch, '" ST-700, LEVER')
   WHEN 4 THEN concat('GRVD BFV ', CASE inch WHEN '2 1/2' THEN '2.5' ELSE inch END, ' COPPER, FIG 215')
   WHEN 5 THEN concat('GD48638N GRVD BFV ', CASE inch WHEN '2 1/2' THEN '2-1/2' ELSE inch END, '" RAL 3000')
   WHEN 6 THEN concat('DI GROOVED BFV DN', dn, ', 16BAR')
   WHEN 7 THEN 'DI GROOVED BFV 88MM, HD371'
   WHEN 8 THEN concat('GATE VALVE SUITABLE FOR DN40 DN', dn, ' DN25')
   WHEN 9 THEN concat('CLAMP SUIT FOR 21.3MM ', od, '.4MM')
   WHEN 10 THEN concat('DI FLGD OS&Y GATE VALVE ', inch, '"/DN', dn, ', 16BAR, STEM PRE-NOTCHED')
   WHEN 11 THEN concat('WAFER BUTTERFLY VALVE ', inch, '", DN', dn, ' NBR SEAT TAMPER SWITCH')
   WHEN 12 THEN concat('SUPERVISORY SWITCH FOR BFV DN', dn)
   WHEN 13 THEN concat('REPAIR KIT FOR GATE VALVE DN', dn)
   WHEN 14 THEN concat('LUG BUTTERFLY VALVE, VITON SEAT, CS DISC, HIGHER LEVER, LONG NECK, ', dn, 'MM')
   WHEN 15 THEN concat('TRIPLE ECCENTRIC BFV FLGD, PTFE SEAT, SS304 DISC, MOTORIZED, DRAIN HOLE, AWWA, DN', dn)
   WHEN 16 THEN concat('DOUBLE ECCENTRIC WAFER LUG BFV, DI+EPDM DISC, NO DRIVE, JIS 10K, DN ', dn)
   WHEN 17 THEN concat('DI FLGD SWING CV DN', dn, ', CS SEAT')
   WHEN 18 THEN concat('GV OSY NRS DI THD BSP DN', dn, ' ANSI CL 150')
   WHEN 19 THEN concat('BALL VALVE NPT DN', dn)
   WHEN 20 THEN ''
   WHEN 21 THEN concat('CONTROL VALVE ', dn, 'MM EPOXY COATED')
   WHEN 22 THEN concat('DI GRVD BV ', inch, '" 10 BAR')
   WHEN 23 THEN concat('FIRERISER WAFERBFV THEREADED DN', dn, ', DI+NBR DISC, AL HANDLE, LOCKABLE')
   WHEN 24 THEN 'INDEX PLATE, NEW TURBINE, NORMAL CLOSE 70G'
   ELSE concat('XD371X BUNA-N SEATED CI LUGGED VALVE ', inch, '"') END AS description
 FROM (
  SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(4)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-', CAST(CAST(l_quantity AS INT) AS VARCHAR(8))) AS row_id,
   CAST(o_orderdate AS DATE) AS contract_date, CAST(o_orderkey AS VARCHAR(20)) AS order_no, c_name AS customer,
   p_partkey, p_brand, p_type, p_size, (p_partkey + l_linenumber * 5) % 26 AS shape, (p_partkey + l_linenumber + l_suppkey) % 40 AS code,
   substr('ABCDEFGH', CAST(l_suppkey % 8 AS INT) + 1, 1) AS biz,
   concat('F', substr(p_brand, 7), 'S', CAST(p_size AS VARCHAR(4))) AS form,
   concat('Q', CAST(10 + p_partkey % 7 AS VARCHAR(4))) AS material,
   CASE p_size % 9 WHEN 0 THEN '50' WHEN 1 THEN '65' WHEN 2 THEN '80' WHEN 3 THEN '100' WHEN 4 THEN '125' WHEN 5 THEN '150' WHEN 6 THEN '200' WHEN 7 THEN '250' ELSE '300' END AS dn,
   CASE p_size % 9 WHEN 0 THEN '2' WHEN 1 THEN '2 1/2' WHEN 2 THEN '3' WHEN 3 THEN '4' WHEN 4 THEN '5' WHEN 5 THEN '6' WHEN 6 THEN '8' WHEN 7 THEN '10' ELSE '12' END AS inch,
   CASE p_size % 9 WHEN 0 THEN '60' WHEN 1 THEN '76' WHEN 2 THEN '89' WHEN 3 THEN '114' WHEN 4 THEN '140' WHEN 5 THEN '168' WHEN 6 THEN '219' WHEN 7 THEN '273' ELSE '324' END AS od,
   CASE p_size % 9 WHEN 0 THEN '54' WHEN 1 THEN '67' WHEN 2 THEN '79' WHEN 3 THEN '105' WHEN 4 THEN '130' WHEN 5 THEN '156' WHEN 6 THEN '206' WHEN 7 THEN '257' ELSE '308' END AS tube
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey) a) b
"""


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_bytes(spark: SparkSession, folder: str, name: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(path).getLength()


def order_history(spark: SparkSession, folder: str) -> DataFrame:
    """The order-history rows derived from the star tables in a folder."""
    return _order_view(spark, folder, ORDER_HISTORY_SQL)


def order_slices(spark: SparkSession, folder: str, variants: bool = False) -> list[DataFrame]:
    """The order-history rows, or their variants, in frames by the hash of their order, as many as the lines need.

    Narrow lines take a quarter of what rows of texts and names do, and every frame reads parts and
    customers anew.
    """
    n = slices_for(table_bytes(spark, folder, "lineitem") // 4)
    statement = ORDER_VARIANTS_SQL if variants else ORDER_HISTORY_SQL
    return [_order_view(spark, folder, statement, i, n) for i in range(n)]


def order_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The same order lines in the rarer wordings and codes."""
    return _order_view(spark, folder, ORDER_VARIANTS_SQL)


def _order_view(spark: SparkSession, folder: str, statement: str, i: int = 0,
                n: int = 1) -> DataFrame:
    """The rows of a statement; of n slices of the orders, the rows of slice i.

    Lines are dealt by order, as the join needs them anyway, before their strings are made: a file
    of few row groups would go through view and parse in as few tasks. Behind the view a step
    without code of its own parts its code from that of the parse, since the JVM does not compile
    a method of both.
    """
    tables = {t: read_table(spark, folder, t) for t in ("lineitem", "orders", "part", "customer")}
    tables["lineitem"] = tables["lineitem"].select(*LINE_COLUMNS)
    if n > 1:
        for t, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
            tables[t] = tables[t].filter(F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(n)) == i)
    else:
        tables["lineitem"] = tables["lineitem"].repartition("l_orderkey")
    return spark.sql(
        statement.replace("FROM lineitem JOIN orders", "FROM {lineitem} JOIN {orders}")
        .replace("JOIN part ON", "JOIN {part} ON").replace("JOIN customer ON", "JOIN {customer} ON"),
        **tables).coalesce(UNLIMITED)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Trim header names, fail with the list of missing columns, keep the needed ones first."""
    trimmed = df.toDF(*[c.strip() for c in df.columns])
    missing = [c for c in columns if c not in trimmed.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return trimmed


def load_orders(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    needed = columns or ORDER_COLUMNS
    checked = require_columns(df, needed)
    keep = [c for c in ("row_id", "customer_document") if c in checked.columns and c not in needed]
    return checked.select(*keep, *needed)


def prepare_orders(orders: DataFrame) -> DataFrame:
    """Normalised keys, parsed code and parsed specification of every order row.

    raw_* keep the source text; form_code, surface are blank unless the code parsed.
    """
    # Codes are normalised once, ahead of the parses that read them.
    document = fingerprint(F.col("customer_document")) if "customer_document" in orders.columns \
        else F.lit("")
    codes = orders.select(
        "row_id", _date(orders).alias("date"), "order_no",
        F.col("product_code").alias("raw_code"),
        blank(F.col("description")).alias("raw_description"),
        normalize_text(F.col("description")).alias("description"),
        *[normalize_code(F.col(c)).alias(c) for c in ("by1", "spec", "material")],
        normalize_code(F.col("product_code")).alias("code"),
        fingerprint(F.col("customer")).alias("customer_key"), document.alias("document_key"))
    parsed = codes.withColumn("pc", parse_normalized_code(
        F.col("code"), F.col("by1"), F.col("spec"), F.col("material")))
    ok = F.col("pc.status") == "ok"
    return parsed.select(
        "row_id", "date", "order_no", "raw_code", "raw_description", "description", "by1", "spec",
        "material", F.when(ok, F.col("pc.form_code")).otherwise("").alias("form_code"),
        F.when(ok, F.col("pc.surface")).otherwise("").alias("surface"),
        F.col("pc.business_prefix").alias("business_prefix"),
        F.col("pc.status").alias("code_status"), "customer_key", "document_key",
        parse_normalized_spec(F.col("spec")).alias("parsed_spec"))


def _date(orders: DataFrame) -> Column:
    """The contract date; a date of four-digit years is taken as it is, without its text."""
    date = F.col("contract_date")
    if not isinstance(orders.schema["contract_date"].dataType, DateType):
        return safe_date(date)
    return F.when(F.year(date).between(1, 9999), date).otherwise(safe_date(date))


def before(rows: DataFrame, date: str | None) -> DataFrame:
    """Rows before an ISO date; all rows without one."""
    return rows if date is None else rows.filter(F.col("date") < F.lit(date).cast("date"))


def usable(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("description") != "") & (F.col("by1") != "") & (F.col("spec") != ""))


def window_tag(date: Column, train_before: str, holdout_from: str) -> Column:
    """train / validation / holdout by half-open bounds; null without a date."""
    train, holdout = F.lit(train_before).cast("date"), F.lit(holdout_from).cast("date")
    return (F.when(date < train, "train").when(date < holdout, "validation")
            .when(date >= holdout, "holdout"))


def holdout_rows(rows: DataFrame, holdout_from: str) -> DataFrame:
    """Labelled rows from the cut on, with a parsed form code."""
    return rows.filter(
        (F.col("date") >= F.lit(holdout_from).cast("date")) & (F.col("raw_description") != "")
        & (F.col("by1") != "") & (F.col("spec") != "") & (F.col("form_code") != ""))


def code_quarantine(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("code_status") != "ok").select("row_id", "raw_code", "code_status")


def code_status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("code_status").agg(F.count(F.lit(1)).alias("rows"))


def load_points(points: DataFrame) -> DataFrame:
    """Vector points with a variety and a vector; codes trimmed, support not below 0."""
    by1 = F.upper(strip(blank(F.col("by1"))))
    return (points.filter((by1 != "") & F.col("vector").isNotNull())
            .withColumns({"by1": by1, "point_id": F.col("point_id").cast("string"),
                          "vector": F.col("vector").cast("array<double>"),
                          "support": F.greatest(F.coalesce(F.col("support"), F.lit(0)), F.lit(0))
                          .cast("bigint")}))
