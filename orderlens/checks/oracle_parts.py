"""Named SQL parts from which the check statements are put together (DuckDB dialect)."""

from __future__ import annotations

from functools import reduce

from ..functions import sizes as SZ
from ..functions import standardize as ST
from ..operators import design as DS
from ..operators.dictionary import DEFAULT_TERMS
from ..sources.orders import ORDER_HISTORY_SQL, TRAIN_BEFORE, VALIDATION_BEFORE

TRAIN, HOLDOUT = f"DATE '{TRAIN_BEFORE}'", f"DATE '{VALIDATION_BEFORE}'"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(column: str) -> str:
    return (f"trim(regexp_replace(replace(upper(replace({column}, 'ß', 'SS')), 'BUNA-N', 'NBR'), "
            r"'[^\p{L}\p{N}]+', ' ', 'g'))")


def code(column: str) -> str:
    return rf"regexp_replace(upper({column}), '\s+', '', 'g')"


def contains(*words: str, text: str = "t") -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def re(pattern: str, text: str = "t") -> str:
    return f"regexp_matches({text}, {quote(pattern)})"


def label(score: str, support: str) -> str:
    return (f"CASE WHEN {score} >= 0.85 AND {support} >= 2 THEN 'high' "
            f"WHEN {score} >= 0.60 THEN 'medium' ELSE 'low' END")


def chain_replace(pairs: list[tuple[str, str]], start: str) -> str:
    return reduce(lambda sql, p: f"regexp_replace({sql}, {quote(p[0])}, {quote(p[1])}, 'g')",
                  pairs, start)


def mapping(table: dict, key: str) -> str:
    cases = " ".join(f"WHEN {quote(str(k))} THEN {quote(str(v))}" for k, v in table.items())
    return f"CASE {key} {cases} END"


def _clean() -> str:
    text = "upper(raw)"
    for wrong, right in ST.SPELLING:
        text = f"replace({text}, {quote(wrong)}, {quote(right)})"
    glued = [(rf"(\w)({w})" if side == "before" else rf"({w})(\w)", r"\1 \2")
             for side, w in ST.GLUED]
    return rf"trim(regexp_replace({chain_replace(glued, text)}, '\s+', ' ', 'g'))"


def _extra() -> str:
    found = ", ".join(f"regexp_extract_all(u, {quote(p)})" for p in ST.EXTRA_PATTERNS)
    return f"list_transform(flatten([{found}]), lambda x: trim(x))"


_FORM_SIZE = {str(v): SZ.INCH_TO_DN and k for k, v in SZ.INCH_TO_DN.items()}
_INCH_TEXT = {str(v): ("1 1/2" if k == 1.5 else "2 1/2" if k == 2.5 else str(k))
              for k, v in SZ.INCH_TO_DN.items()}

PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (list(needs), sql)


def sql(main: str, *needs: str) -> str:
    """The main statement with all parts it needs in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in PARTS[name][0]:
            visit(need)
        order.append(name)

    for name in needs:
        visit(name)
    head = ", ".join(f"{n} AS ({PARTS[n][1]})" for n in order)
    recursive = "RECURSIVE " if any("UNION ALL\n" in PARTS[n][1] for n in order) else ""
    return f"WITH {recursive}{head} {main}" if order else main


part("order_history", ORDER_HISTORY_SQL)
part("pc", r"""
SELECT *, CASE WHEN raw = '' THEN 'missing_code' WHEN NOT found THEN 'spec_segment_not_found'
  WHEN cut = 0 THEN 'material_not_found' WHEN NOT ends THEN 'by1_mismatch'
  WHEN form = '' THEN 'empty_form_code' WHEN head <> w_by1 AND prefix = '' THEN 'business_prefix_missing'
  ELSE 'ok' END AS status
FROM (SELECT *, CASE WHEN ends AND length(head) - length(w_by1) = 1 THEN left(head, 1) ELSE '' END AS prefix,
    trim(substr(tail, 1, cut - 1), '_') AS form, trim(substr(tail, cut + length(w_mat)), '_') AS surface
  FROM (SELECT *, CASE WHEN found THEN strpos(tail, w_mat) ELSE 0 END AS cut,
      coalesce(ends_with(head, w_by1), false) AS ends
    FROM (SELECT *, coalesce(pos > 1 AND pos < len(parts), false) AS found,
        array_to_string(parts[1:pos - 1], '_') AS head, array_to_string(parts[pos + 1:], '_') AS tail
      FROM (SELECT *, list_position(parts, w_spec) AS pos
        FROM (SELECT *, regexp_replace(upper(product_code), '\s+', '', 'g') AS raw,
            upper(by1) AS w_by1, upper(spec) AS w_spec, upper(material) AS w_mat,
            string_split(regexp_replace(upper(product_code), '\s+', '', 'g'), '_') AS parts
          FROM order_history)))))""", "order_history")
part("prep", f"""
SELECT row_id, contract_date AS date, order_no, product_code AS raw_code,
  description AS raw_description, {norm('description')} AS description, w_by1 AS by1, w_spec AS spec,
  w_mat AS material, CASE WHEN status = 'ok' THEN form ELSE '' END AS form_code,
  CASE WHEN status = 'ok' THEN surface ELSE '' END AS surface, CASE WHEN found THEN prefix ELSE '' END AS business_prefix,
  status AS code_status, sha256({norm('customer')}) AS customer_key,
  regexp_extract(w_spec, '^([A-Z]+)[0-9]', 1) AS spec_prefix,
  regexp_extract(w_spec, '^[A-Z]+([0-9]+)$', 1) AS spec_size
FROM pc""", "pc")
part("hist", f"SELECT * FROM prep WHERE date < {HOLDOUT}", "prep")
part("hold", f"SELECT * FROM prep WHERE date >= {HOLDOUT} AND form_code <> ''", "prep")
part("texts", "SELECT DISTINCT description AS raw FROM order_history", "order_history")
part("sized", r"""
SELECT raw, CASE WHEN rule = '' THEN NULL WHEN rule = 'grooved_dn_to_od' THEN od ELSE num END AS size,
  nullif(rule, '') AS rule
FROM (SELECT raw, coalesce(mm, dn) AS num, od, CASE
    WHEN grooved AND mm IS NOT NULL THEN '' WHEN grooved AND od IS NOT NULL THEN 'grooved_dn_to_od'
    WHEN grooved THEN '' WHEN mm IS NOT NULL THEN 'explicit_mm' WHEN dn IS NOT NULL THEN 'dn_size' ELSE '' END AS rule
  FROM (SELECT raw, dn, mm, grooved, """ + mapping(SZ.GROOVED_DN_TO_OD, "dn") + r""" AS od
    FROM (SELECT raw, nullif(regexp_extract(raw, '\bDN\s*(\d+)\b', 1), '') AS dn,
      nullif(regexp_extract(raw, '\b(\d+)\s*MM\b', 1), '') AS mm,
      regexp_matches(raw, '\b(GROOVED|GROOVE|GRVD|GRV)\b') AS grooved FROM texts)))""", "texts")
part("clean", f"SELECT raw, upper(raw) AS u, {_clean()} AS t FROM texts", "texts")
part("feat", f"""
SELECT *, CASE WHEN seat_name = 'PTFE' THEN 'F' WHEN seat_name = 'CS' THEN 'H' WHEN seat_name = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'X' END AS seat_material,
  strong OR {re(r'XD[0-9][0-9][0-9][XFH]')} AS has_signal, weak AND NOT strong AS has_signal_weak
FROM (SELECT *, {contains(*ST.STRONG_SIGNAL)} AS strong, {contains(*ST.WEAK_SIGNAL)} AS weak,
  CASE WHEN {contains('THREADED', 'THD', 'BSP', 'NPT')} THEN 'THREADED' WHEN {contains('FLGD', 'FLANGE')} THEN 'FLANGED'
    WHEN {contains('GRVD', 'GRV', 'GROOVE', 'GR BFV', 'GR BV')} THEN 'GROOVED'
    WHEN contains(t, 'LUG') AND {contains('WAFER', 'WAF ', 'WAF.')} THEN 'LUG_WAFER'
    WHEN contains(t, 'LUG') THEN 'LUG' WHEN {contains('WAFER', 'WAF ', 'WAF.')} THEN 'WAFER' ELSE 'UNKNOWN' END AS connection,
  CASE WHEN {contains('TRIPLE ECCENTRIC', '3 ECCENTRIC', '3 ENCENTRIC')} THEN '3'
    WHEN {contains('DOUBLE ECCENTRIC', 'HIGH PERFORMANCE')} THEN '2' ELSE '1' END AS valve_structure,
  CASE WHEN {contains('PTFE', 'TEFLON', 'T SEAL')} THEN 'PTFE' WHEN contains(t, 'CS SEAT') THEN 'CS'
    WHEN contains(t, 'NBR') THEN 'NBR' WHEN contains(t, 'EPDM') THEN 'EPDM' WHEN {contains('VITON', 'VTON')} THEN 'VITON' ELSE 'UNKNOWN' END AS seat_name,
  CASE WHEN {contains(*ST.NO_DRIVE_WORDS)} THEN 'NO_DRIVE' WHEN contains(t, 'LEVER') THEN 'LEVER'
    WHEN {contains(*ST.GEAR_WORDS)} THEN 'GEAR' WHEN {contains('MOTORIZED', 'ACTUATOR')} THEN 'MOTORIZED' ELSE 'UNKNOWN' END AS actuation,
  CASE WHEN {re(r'316\s*DISC')} THEN 'SS316' WHEN {re(r'304\s*DISC')} THEN 'SS304'
    WHEN {contains('DI+EPDM DISC', 'DI EPDM DISC')} THEN 'DI_EPDM' WHEN contains(t, 'DI+NBR DISC') THEN 'DI_NBR'
    WHEN contains(t, 'CS DISC') THEN 'CS' WHEN {re(r'DI\s*DISC|DUCTILE\s*DISC')} THEN 'DI' ELSE 'UNKNOWN' END AS disc_material,
  {contains('LOCKABLE', 'INFINITE')} AS is_lockable, contains(t, 'LONG NECK') AS is_long_neck, contains(t, 'HIGHER LEVER') AS is_higher_lever
  FROM clean)""", "clean")
_CONN = mapping({"WAFER": "WAFER", "LUG_WAFER": "LUG WAFER", "LUG": "LUG", "GROOVED": "GRVD",
                 "FLANGED": "FLGD", "THREADED": "THD"}, "connection")
_DISC = mapping({"SS316": "SS316 DISC", "SS304": "SS304 DISC", "DI_EPDM": "DI+EPDM DISC",
                 "DI_NBR": "DI+NBR DISC", "DI": "DI DISC", "CS": "CS DISC"}, "disc_material")
_ACT = mapping({"GEAR": "GEAR", "LEVER": "LEVER", "MOTORIZED": "MOTORIZED",
                "NO_DRIVE": "BARE SHAFT"}, "actuation")
_COVERED = chain_replace([(p, " ") for p in ST.COVERED_PATTERNS], "u")
part("segs", rf"""
SELECT *, concat_ws(',', body, nullif(seat, ''), nullif(disc, ''), nullif(act, ''), nullif(size, ''), nullif(pressure, ''), nullif(extra, '')) AS standardized,
  CASE WHEN {re(ST.VALVE_WORDS)} THEN concat_ws(',', body, nullif(seat, ''), nullif(disc, ''), nullif(act, ''), nullif(pressure, ''), nullif(extra, ''))
    ELSE trim(regexp_replace({chain_replace([(r'\bDN\s*\d+(?:\.\d+)?\b', ' '), (r'\b\d+(?:\.\d+)?\s*MM\b', ' '), (r'\b\d+(?:\s+\d+/\d+)?\s*"', ' ')], 't')}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) END AS semantic_text
FROM (SELECT *, concat_ws(' ', CASE WHEN has_signal OR has_signal_weak THEN 'UL/FM' END, 'DI', {_CONN}, 'BFV',
    CASE valve_structure WHEN '2' THEN 'DOUBLE ECCENTRIC' WHEN '3' THEN 'TRIPLE ECCENTRIC' END, CASE WHEN has_signal THEN 'W/TAMPER SWITCH' END) AS body,
  CASE WHEN seat_name = 'UNKNOWN' THEN '' ELSE seat_name || ' SEAT' END AS seat, coalesce({_DISC}, '') AS disc,
  concat_ws(' ', {_ACT}, CASE WHEN is_higher_lever THEN 'HIGHER' END, CASE WHEN is_lockable THEN 'LOCKABLE' END, CASE WHEN is_long_neck THEN 'LONG NECK' END) AS act,
  CASE WHEN dn = '' THEN '' ELSE concat_ws('/', {mapping(_INCH_TEXT, 'dn')} || '"', 'DN' || dn) END AS size,
  coalesce(nullif(regexp_extract(u, '(\d+)\s*PSI', 1), '') || 'PSI', 'PN' || nullif(regexp_extract(u, '\bPN(\d+)\b', 1), ''), '') AS pressure,
  array_to_string(list_concat(ex, list_filter(w, lambda x: NOT list_contains(ex, x))), ' ') AS extra
  FROM (SELECT *, regexp_extract(u, 'DN(\d+)', 1) AS dn FROM (SELECT *,
      list_filter({_extra()}, lambda x: x <> '') AS ex,
      list_filter(string_split(trim(regexp_replace(regexp_replace({_COVERED}, '[,.\-/]+\s*', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^\d+$')) AS w
    FROM feat)))""", "feat")
# Description design.
part("dtext", r"""
SELECT DISTINCT description AS raw, by1,
  trim(regexp_replace(upper(description), '\s+', ' ', 'g')) AS t FROM order_history""", "order_history")
_FULL = " ".join(f"WHEN {re(p)} THEN '{n}'" for n, p in DS.FULL_NAMES.items())
_CTX = f"({re(DS.BODY_CONTEXT)} AND {re(DS.CONNECTION_CONTEXT)})"
_SHORT = " ".join(f"WHEN {re(p)} AND ({_CTX} OR {re(a)}) THEN '{n}'"
                  for n, (p, a) in DS.SHORT_NAMES.items())
_SHAPE = " ".join(f"WHEN {re(p, 'by1')} THEN '{n}'" for n, p in DS.CODE_SHAPES.items())
part("dfam", f"""
SELECT raw, by1, t, CASE WHEN {re(DS.ACCESSORY)} THEN 'accessory' WHEN {re(DS.SPARE)} THEN 'spare_part'
    WHEN fam IS NULL THEN 'other' ELSE 'valve' END AS role, fam
FROM (SELECT *, CASE WHEN {re(DS.UNSUPPORTED)} THEN NULL {_FULL} {_SHORT} {_SHAPE} END AS fam FROM dtext)""",
     "dtext")
_TERMS = ", ".join(
    f"({i}, {quote(t)}, {quote(v)}, {quote(f)}, {quote(s)}, {p}, "
    + quote(r"(^|[^A-Z0-9])" + r"\s+".join(
        "".join("\\" + c if not c.isalnum() else c for c in w) for w in t.split(" "))
        + r"([^A-Z0-9]|$)") + ")"
    for i, (t, v, f, s, p) in enumerate(DEFAULT_TERMS))
part("terms", f"SELECT * FROM (VALUES {_TERMS}) AS d(pos, term, value, field, scope, priority, pattern)")
part("matched", """
SELECT raw, by1, field, value, term FROM (
  SELECT raw, by1, field, value, term, row_number() OVER (PARTITION BY raw, by1, field ORDER BY length(term) DESC, priority DESC, pos) AS rn
  FROM dfam JOIN terms ON (scope = '' OR scope = fam) AND regexp_matches(t, pattern) WHERE role = 'valve') WHERE rn = 1""",
     "dfam", "terms")
_OD = mapping(SZ.DESIGN_DN_TO_OD, "dn")
_DINCH = mapping(SZ.DESIGN_DN_TO_INCH, "dn")
part("dattr", rf"""
SELECT raw, by1, field, value FROM matched
UNION ALL SELECT raw, by1, 'pressure', p FROM (SELECT raw, by1, coalesce('PN' || nullif(regexp_extract(t, '\bPN\s*(\d+)\b', 1), ''),
   nullif(regexp_extract(t, '\b(\d+)\s*PSI\b', 1), '') || ' PSI') AS p FROM dfam WHERE role = 'valve') WHERE p IS NOT NULL
UNION ALL SELECT raw, by1, 'special_requirements', 'LOCKABLE' FROM dfam WHERE role = 'valve' AND regexp_matches(t, '\bLOCKABLE\b')
UNION ALL SELECT raw, by1, 'size', CASE WHEN conn = 'GROOVED' AND {_OD} IS NOT NULL THEN {_DINCH} || '"/' || {_OD} || 'MM' ELSE {_DINCH} || '"/DN' || dn END
  FROM (SELECT d.raw, d.by1, m.value AS conn, regexp_extract(t, '\bDN\s*(\d+)\b', 1) AS dn
    FROM dfam d LEFT JOIN matched m ON m.raw = d.raw AND m.by1 = d.by1 AND m.field = 'connection' WHERE role = 'valve') WHERE dn <> ''""",
     "matched", "dfam")
_PIV = ", ".join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}" for f in DS.ATTRIBUTE_FIELDS)
_ATTR_SIG = "string_agg(field || '=' || value, '|' ORDER BY field) FILTER (field <> 'size') AS sig"
part("dwide", f"SELECT raw, by1, {_PIV}, {_ATTR_SIG} FROM dattr GROUP BY raw, by1", "dattr")


def render_sql(fam: str = "fam") -> str:
    return (f"concat_ws(', ', concat_ws(' ', body_material, connection, structure, CASE {fam} "
            "WHEN 'butterfly' THEN 'BUTTERFLY VALVE' WHEN 'check' THEN 'CHECK VALVE' ELSE 'GATE VALVE' END), "
            f"seat_material || ' SEAT', closure_material || CASE {fam} WHEN 'gate' THEN ' WEDGE' ELSE ' DISC' END, "
            "actuation, special_requirements, pressure, standard_certification, size)")


_MISSING = ("list_filter(['body_material', 'connection', 'size'], lambda x: (x = 'body_material' AND body_material IS NULL) "
            "OR (x = 'connection' AND connection IS NULL) OR (x = 'size' AND size IS NULL))")


def finish_sql(source: str, inferred_count: str) -> str:
    """Template id, text, status, score and warnings over a pivoted attribute row."""
    return f"""
SELECT *, CASE WHEN role = 'valve' THEN upper(left(fam, 3)) || '-' || upper(left(sha1(fam || '|' || coalesce(sig, '')), 10)) END AS template_id,
  CASE WHEN role = 'valve' THEN {render_sql()} END AS standardized_description,
  CASE WHEN role IN ('accessory', 'spare_part') THEN 'excluded' WHEN role <> 'valve' THEN 'unsupported' WHEN len(missing) = 0 THEN 'complete' ELSE 'partial' END AS status,
  CASE WHEN role <> 'valve' THEN 0.0 WHEN len(missing) = 0 AND {inferred_count} = 0 THEN 0.99 WHEN len(missing) = 0 THEN 0.95
    ELSE round(greatest(0.6, 0.9 - 0.1 * len(missing)), 4) END::DOUBLE AS score,
  CASE WHEN role = 'valve' THEN array_to_string(list_transform(missing, lambda x: 'missing_' || x), ';') ELSE '' END AS warnings
FROM (SELECT *, {_MISSING} AS missing FROM {source})"""


part("dplain", finish_sql(
    "(SELECT f.raw, f.by1, f.role, f.fam, w.* EXCLUDE (raw, by1) FROM dfam f LEFT JOIN dwide w "
    "ON w.raw = f.raw AND w.by1 = f.by1)", "0"), "dfam", "dwide")
# Evidence and cascades.
for target in ("by1", "spec"):
    part(f"ev_{target}", f"""
SELECT 'description_form' AS level, description, form_code, '' AS customer_key, {target} AS value, count(*) AS n FROM hist GROUP BY ALL
UNION ALL SELECT 'description', description, '', '', {target}, count(*) FROM hist GROUP BY ALL
UNION ALL SELECT 'description_form_customer', description, form_code, customer_key, {target}, count(*) FROM hist GROUP BY ALL
UNION ALL SELECT 'description_customer', description, '', customer_key, {target}, count(*) FROM hist GROUP BY ALL""", "hist")
part("ev_legacy", """
SELECT level, description, form_code, customer_key, value, n FROM (
SELECT 'description_form' AS level, description, by1 AS form_code, '' AS customer_key, spec AS value, count(*) AS n FROM hist GROUP BY ALL
UNION ALL SELECT 'description', description, '', '', spec, count(*) FROM hist GROUP BY ALL
UNION ALL SELECT 'description_form_customer', description, by1, customer_key, spec, count(*) FROM hist GROUP BY ALL
UNION ALL SELECT 'description_customer', description, '', customer_key, spec, count(*) FROM hist GROUP BY ALL)""", "hist")


def ranked(evidence: str) -> str:
    return f"""
SELECT *, sum(n) OVER k AS total, row_number() OVER (PARTITION BY level, description, form_code, customer_key ORDER BY n DESC, value) AS rank
FROM {evidence} WINDOW k AS (PARTITION BY level, description, form_code, customer_key)"""


for target in ("by1", "spec", "legacy"):
    part(f"rk_{target}", ranked(f"ev_{target}"), f"ev_{target}")


def tagged(form: str) -> str:
    return f"""
SELECT {form} AS form, raw_description AS raw, spec_prefix, spec_size, spec,
  CASE WHEN date < {TRAIN} THEN 'train' WHEN date < {HOLDOUT} THEN 'validation' ELSE 'holdout' END AS win
FROM prep WHERE {form} <> '' AND spec_size <> ''"""


for form, name in (("by1", "tag_by1"), ("form_code", "tag_form")):
    part(name, tagged(form), "prep")
    part(f"pur_{name}", f"""
SELECT form, win, min_by(spec_prefix, (-n, spec_prefix)) AS prefix, sum(n) AS support, max(n) / sum(n) AS purity
FROM (SELECT form, win, spec_prefix, count(*) AS n FROM {name} GROUP BY ALL) GROUP BY form, win""", name)
    part(f"gate_{name}", f"""
SELECT t.form, t.prefix, t.support AS train_support, v.support AS validation_support
FROM pur_{name} t JOIN pur_{name} v ON t.form = v.form AND t.win = 'train' AND v.win = 'validation'
WHERE t.support >= 20 AND t.purity = 1 AND v.support >= 5 AND v.purity = 1 AND t.prefix = v.prefix""", f"pur_{name}")
    actual = "t.spec" if form == "form_code" else "t.spec_prefix || t.spec_size"
    part(f"rules_{name}", f"""
SELECT form, prefix, train_support, validation_support, ts AS train_combined_support, vs AS validation_combined_support
FROM (SELECT g.form, g.prefix, g.train_support, g.validation_support,
    count(*) FILTER (win = 'train') AS ts, count(*) FILTER (win = 'train' AND ok) AS tr,
    count(*) FILTER (win = 'validation') AS vs, count(*) FILTER (win = 'validation' AND ok) AS vr
  FROM (SELECT t.form, t.win, g.prefix || s.size = {actual} AS ok FROM {name} t JOIN gate_{name} g ON t.form = g.form JOIN sized s ON s.raw = t.raw AND s.size IS NOT NULL) x
  JOIN gate_{name} g ON x.form = g.form GROUP BY ALL) WHERE ts >= 20 AND ts = tr AND vs >= 5 AND vs = vr""",
         name, f"gate_{name}", "sized")

# Distinct holdout requests without a customer.
part("req", "SELECT DISTINCT raw_description AS query, description, form_code FROM hold", "hold")
# Distinct holdout requests of the specification index: the variety is the form.
part("lreq", "SELECT DISTINCT raw_description AS query, description, by1 AS form_code, customer_key FROM hold", "hold")


def first_hits(requests: str, ranking: str, order: list[tuple[str, str]], key: str) -> str:
    """Rows of the first level with evidence per request; order holds (level, join condition)."""
    unions = " UNION ALL ".join(
        f"SELECT {i} AS lv, '{level}' AS level, {', '.join('q.' + c for c in key.split(', '))}, e.rank, e.value, e.n, e.total "
        f"FROM {requests} q JOIN {ranking} e ON e.level = '{level}' AND e.description = q.description AND {cond}"
        for i, (level, cond) in enumerate(order))
    return f"SELECT * FROM (SELECT *, min(lv) OVER (PARTITION BY {key}) AS best FROM ({unions})) WHERE lv = best"


part("by1_hit", first_hits("req", "rk_by1", [
    ("description_form", "e.form_code = q.form_code"), ("description", "true")],
    "query, form_code"), "req", "rk_by1")
