"""Scalar functions and classifiers over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import compare as C
from ..functions import sizes as S
from ..functions import text as T
from ..runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# --- the same functions as SQL text ------------------------------------------------------------

WS = r"[\s\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(v: str) -> str:
    return f"regexp_replace({v}, '^{WS}+|{WS}+$', '', 'g')"


def key(v: str) -> str:
    return f"upper({trim(v)})"


def blank(v: str) -> str:
    t = f"upper({trim(v)})"
    words = ", ".join(q(w) for w in ("", *T.PLACEHOLDERS))
    return f"({v} IS NULL OR {t} IN ({words}) OR regexp_matches(regexp_extract({t}, '^[^\\s\\x{{00a0}}]+'), {q(T.PLACEHOLDER_TOKEN)}))"


def num(v: str) -> str:
    return f"(CASE WHEN NOT {blank(v)} THEN TRY_CAST(regexp_extract(replace({v}, ',', ''), '-?\\d+(\\.\\d+)?') AS DOUBLE) END)"


def unit(v: str) -> str:
    return f"nullif(regexp_replace(lower(regexp_extract({trim(v)}, '^-?[\\d.,]+{WS}*(.*)$', 1)), '{WS}+', '', 'g'), '')"


def js(col: str, path: str) -> str:
    return f"json_extract_string({col}, '$.{path}')"


def cases(t: str, rules: list[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, {q(p)}) THEN {q(n)}" for n, p in rules) + f" ELSE {default} END"


def low(v: str) -> str:
    return f"lower(coalesce({v}, ''))"


def nps(v: str) -> str:
    t = trim(f"replace({trim(v)}, '\"', '')")
    g = lambda p, i: f"TRY_CAST(regexp_extract({t}, {q(p)}, {i}) AS DOUBLE)"
    mixed, part = r"^(\d+)(?:\.|\s+)(\d+)/(\d+)$", r"^(\d+)/(\d+)$"
    return f"(CASE WHEN regexp_matches({t}, {q(mixed)}) THEN {g(mixed, 1)} + {g(mixed, 2)} / {g(mixed, 3)} WHEN regexp_matches({t}, {q(part)}) THEN {g(part, 1)} / {g(part, 2)} WHEN regexp_matches({t}, '^[-+]?(\\d+\\.?\\d*|\\.\\d+)$') THEN TRY_CAST({t} AS DOUBLE) END)"


def pick(table_: dict, v: str, kind: str) -> str:
    return "(CASE " + " ".join(f"WHEN {v} = {k} THEN CAST({x} AS {kind})" for k, x in table_.items()) + " END)"


def dn(v: str) -> str:
    first = trim(f"regexp_extract({v}, '^[^xX×]*')")
    frac = r"^(?:(\d+)\s+)?(\d+)\s*/\s*(\d+)"
    g = lambda i: f"TRY_CAST(nullif(regexp_extract({first}, {q(frac)}, {i}), '') AS DOUBLE)"
    value = f"(CASE WHEN regexp_matches({first}, {q(frac)}) THEN coalesce({g(1)}, 0) + {g(2)} / {g(3)} ELSE {num(first)} END)"
    inches = f"(regexp_matches({first}, '\"|inch|\\bin\\b|''''') OR {value} <= {S.INCH_LIMIT})"
    return f"(CASE WHEN {first} = '' OR {value} IS NULL THEN NULL WHEN {inches} THEN coalesce({pick(S.NPS_TO_DN, f'round({value}, 2)', 'INTEGER')}, TRY_CAST(floor({value} * 25.4 + 0.5) AS INTEGER)) ELSE TRY_CAST(floor({value} + 0.5) AS INTEGER) END)"


def bom_class(v: str) -> str:
    t = key(v)
    stem = f"regexp_extract({t}, '^([A-Z]{{2}}\\d{{2}}[A-Z]?)(?:[-\\s].*)?$', 1)"
    return f"regexp_replace(CASE WHEN NOT {blank(v)} THEN CASE WHEN {stem} <> '' THEN {stem} ELSE {t} END END, '^([A-Z]+\\d+[A-Z])1$', '\\1')"


def rating(v: str) -> str:
    n = f"TRY_CAST(regexp_extract(upper({v}), {q(T.RATING)}, 1) AS INTEGER)"
    return f"(CASE WHEN {n} IN ({', '.join(map(str, T.RATINGS))}) THEN {n} END)"


def bag(t: str, fields: list[str], where: str = "true") -> str:
    return f"(SELECT id, project_id, document_id, doc_type, tag_type, tag_number, source_page, created_at, {', '.join(f'{js('attributes', f)} AS {f}' for f in fields)} FROM extracted_tags WHERE {where}) {t}"


# --- queries --------------------------------------------------------------------------------------


def tags(spark: SparkSession, d: str, kind: str | None = None, doc: str | None = None, fields: list[str] = []) -> DataFrame:  # noqa: B006
    """Tags of one kind with the named text fields of their bag."""
    t = table(spark, d, "extracted_tags")
    if kind:
        t = t.filter(F.col("tag_type") == kind)
    if doc:
        t = t.filter(F.col("doc_type") == doc)
    base = ["id", "project_id", "document_id", "doc_type", "tag_type", "tag_number", "source_page", "created_at"]
    if not fields:
        return t.select(*base)
    clash = [f for f in fields if f in base]
    return t.select(*base, F.from_json("attributes", ", ".join(f"{f} string" for f in fields)).alias("_a")).select(*base, *[F.col(f"_a.{f}").alias(f"{f}_" if f in clash else f) for f in fields])


@query(f"SELECT id, {key('tag_number')} AS tag_key, upper({trim(f'regexp_replace(tag_number, {q("[-]|" + WS)}, {q("")}, {q("g")})')}) AS loose_key FROM extracted_tags")
def fn_tag_keys(spark, d):
    return tags(spark, d).select("id", T.tag_key(F.col("tag_number")).alias("tag_key"), T.tag_key(F.col("tag_number"), T.LOOSE).alias("loose_key"))


@query(f"""SELECT id, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, {q(T.SLOPE)}) THEN regexp_extract(t, {q(T.SLOPE)}, 1) || ':' || regexp_extract(t, {q(T.SLOPE)}, 2) ELSE t END AS slope
FROM (SELECT id, {trim('slope')} AS t FROM {bag('b', ['slope'], "tag_type = 'line'")})""")
def fn_slopes(spark, d):
    return tags(spark, d, "line", fields=["slope"]).select("id", T.slope(F.col("slope")).alias("slope"))


@query(f"""WITH s AS (SELECT id, list_filter(list_transform(string_split({trim('line_number')}, '-'), lambda x: trim(x)), lambda x: x <> '') AS p FROM bom_rows)
SELECT id, CASE WHEN ok THEN p[1] || ' mm' END AS size, CASE WHEN ok THEN p[2] END AS service, CASE WHEN ok THEN p[3] END AS spec_class, CASE WHEN ok THEN p[4] END AS unique_no, CASE WHEN ok THEN p[5] END AS insulation_code
FROM (SELECT *, len(p) >= 4 AND regexp_matches(p[1], '^[0-9]+$') AS ok FROM s)""")
def fn_line_parts(spark, d):
    p = table(spark, d, "bom_rows").select("id", T.line_parts(F.col("line_number")).alias("p"))
    return p.select("id", *[F.col(f"p.{c}").alias(c) for c in ("size", "service", "spec_class", "unique_no", "insulation_code")])


@query(f"""WITH b AS (SELECT *, list_filter(list_transform(string_split({trim('tag_number')}, '-'), lambda x: trim(x)), lambda x: x <> '') AS p FROM {bag('t', ['size', 'service', 'spec_class', 'insul_spec'], "tag_type = 'line' AND doc_type = 'iso'")}),
k AS (SELECT *, len(p) >= 4 AND regexp_matches(p[1], '^[0-9]+$') AS ok, coalesce({trim('size')}, '') AS s FROM b)
SELECT id, CASE WHEN ok AND {blank('s')} THEN p[1] || ' mm' WHEN ok AND regexp_matches(s, '^\\d+(\\.\\d+)?$') AND TRY_CAST(s AS DOUBLE) = TRY_CAST(p[1] AS DOUBLE) THEN s || ' mm' ELSE size END AS size,
CASE WHEN ok AND {blank('service')} THEN p[2] ELSE service END AS service, CASE WHEN ok AND {blank('spec_class')} THEN p[3] ELSE spec_class END AS spec_class,
CASE WHEN ok AND {blank('insul_spec')} AND p[5] IS NOT NULL THEN p[5] ELSE insul_spec END AS insul_spec FROM k""")
def fn_completed_lines(spark, d):
    t = tags(spark, d, "line", "iso", ["size", "service", "spec_class", "insul_spec"])
    done = T.completed_line(F.col("tag_number"), {c: F.col(c) for c in ("size", "service", "spec_class", "insul_spec")})
    return t.select("id", *[v.alias(k) for k, v in done.items()])


@query(f"""SELECT id, {blank('iso_value')} AS iso_blank, {blank('pll_value')} AS pll_blank, {num('iso_value')} AS iso_number, {unit('iso_value')} AS iso_unit FROM design_basis""")
def fn_quantity_texts(spark, d):
    i, p = F.col("iso_value"), F.col("pll_value")
    return table(spark, d, "design_basis").select("id", T.blank(i).alias("iso_blank"), T.blank(p).alias("pll_blank"), T.number(i).alias("iso_number"), T.unit(i).alias("iso_unit"))


def _verdict_sql(numeric: bool) -> str:
    a, b = "iso_value", "pll_value"
    text = f"lower({trim(a)}) = lower({trim(b)})"
    if not numeric:
        return f"CASE WHEN {blank(a)} OR {blank(b)} THEN 'not compared' WHEN {text} THEN 'match' ELSE 'mismatch' END"
    fac = lambda t, u: "(CASE " + " ".join(f"WHEN {u} = {q(k)} THEN CAST({v} AS DOUBLE)" for k, v in t.items()) + " END)"
    fa = f"(CASE WHEN na IS NULL OR nb IS NULL THEN NULL WHEN ua IS NULL OR ub IS NULL OR ua = ub THEN 1.0::DOUBLE WHEN {fac(C.TO_BAR, 'ua')} IS NOT NULL AND {fac(C.TO_BAR, 'ub')} IS NOT NULL THEN {fac(C.TO_BAR, 'ua')} WHEN {fac(C.TO_MM, 'ua')} IS NOT NULL AND {fac(C.TO_MM, 'ub')} IS NOT NULL THEN {fac(C.TO_MM, 'ua')} END)"
    fb = f"(CASE WHEN ua IS NULL OR ub IS NULL OR ua = ub THEN 1.0::DOUBLE WHEN {fac(C.TO_BAR, 'ua')} IS NOT NULL THEN {fac(C.TO_BAR, 'ub')} ELSE {fac(C.TO_MM, 'ub')} END)"
    return f"CASE WHEN {blank(a)} OR {blank(b)} THEN 'not compared' WHEN CASE WHEN {fa} IS NOT NULL THEN abs(na * {fa} - nb * {fb}) <= greatest(abs(na * {fa}), abs(nb * {fb}), 1) * 1e-6 ELSE {text} END THEN 'match' ELSE 'mismatch' END"


@query(f"""WITH v AS (SELECT id, iso_value, pll_value, {num('iso_value')} AS na, {num('pll_value')} AS nb, {unit('iso_value')} AS ua, {unit('pll_value')} AS ub FROM design_basis)
SELECT id, {_verdict_sql(True)} AS by_number, {_verdict_sql(False)} AS by_text FROM v""")
def fn_verdicts(spark, d):
    both = C.prepared(table(spark, d, "design_basis"), "iso_value", "pll_value")
    return both.select("id", C.verdict(True).alias("by_number"), C.verdict(False).alias("by_text"))


@query(f"SELECT id, round({nps('size')}, 6) AS nps, {dn('size')} AS dn FROM bom_rows")
def fn_sizes(spark, d):
    s = F.col("size")
    return table(spark, d, "bom_rows").select("id", F.round(S.nps(s), 6).alias("nps"), S.dn(s).alias("dn"))


_LABEL = pick({v: k for k, v in S.NPS_TO_DN.items()}, "dn", "DOUBLE")
_TXT = f"(CASE WHEN {_LABEL} = floor({_LABEL}) THEN CAST(CAST({_LABEL} AS INTEGER) AS VARCHAR) ELSE CAST({_LABEL} AS VARCHAR) END)"


@query(f"""WITH v AS (SELECT id, dn, {pick(S.DN_TO_NPS, 'dn', 'DOUBLE')} AS n FROM valve_matches),
e AS (SELECT *, CAST(floor(n + 1e-9) AS BIGINT) AS w, CAST(floor((n - floor(n + 1e-9)) * 8 + 0.5) AS INTEGER) AS e FROM v),
f AS (SELECT *, CASE WHEN e % 4 = 0 THEN CAST(e // 4 AS VARCHAR) || '/2' WHEN e % 2 = 0 THEN CAST(e // 2 AS VARCHAR) || '/4' ELSE CAST(e AS VARCHAR) || '/8' END AS part FROM e)
SELECT id, CASE WHEN dn IS NULL THEN 'unsized' WHEN {_LABEL} IS NOT NULL THEN {_TXT} || '" (DN' || CAST(dn AS VARCHAR) || ')' ELSE 'DN' || CAST(dn AS VARCHAR) END AS dn_label, n AS nps,
CASE WHEN n IS NULL THEN NULL WHEN e = 0 THEN CAST(w AS VARCHAR) WHEN w > 0 THEN CAST(w AS VARCHAR) || ' ' || part ELSE part END AS nps_label FROM f""")
def fn_size_labels(spark, d):
    n = S.nps_of_dn(F.col("dn").cast("string"))
    return table(spark, d, "valve_matches").select("id", S.dn_label(F.col("dn")).alias("dn_label"), n.alias("nps"), S.nps_label(n).alias("nps_label"))


@query(f"""SELECT id, {bom_class('spec_code')} AS class_code, {rating('description')} AS rating, NOT contains(lower(description), 'orifice') AS tells_class FROM sheet_items""")
def fn_classes(spark, d):
    t = F.col("description")
    return table(spark, d, "sheet_items").select("id", T.bom_class(F.col("spec_code")).alias("class_code"), T.rating(t).alias("rating"), T.tells_class(t).alias("tells_class"))


def _tok(p: str) -> str:
    return f"list_transform(regexp_extract_all(description, {q(p)}), lambda x: upper(regexp_replace(x, '\\s+', '', 'g')))"


@query(f"""SELECT id, coalesce(list_filter({_tok(T.END_TYPE)}, lambda x: x <> 'RF')[1], {_tok(T.END_TYPE)}[1]) AS end_type,
array_to_string(list_sort(list_distinct({_tok(T.STANDARDS[0])} || {_tok(T.STANDARDS[1])} || {_tok(T.STANDARDS[2])})), ' ') AS standards,
nullif(upper(regexp_extract(description, {q(T.SCHEDULE)}, 1)), '') AS schedule,
coalesce(nullif(regexp_extract(description, {q(T.CLASS_RATING)}, 1), ''), nullif(regexp_extract(description, {q(T.CLASS_RATING)}, 2), '')) AS class_rating,
array_to_string(list_sort(list_distinct({_tok(T.GRADE)})), ' ') AS grades FROM sheet_items""")
def fn_tokens(spark, d):
    t = F.col("description")
    return table(spark, d, "sheet_items").select("id", T.end_type(t).alias("end_type"), F.array_join(F.array_sort(T.standards(t)), " ").alias("standards"), T.schedule(t).alias("schedule"), T.class_rating(t).alias("class_rating"), F.array_join(F.array_sort(T.tokens(t, T.GRADE)), " ").alias("grades"))


@query(f"""SELECT id, CASE WHEN regexp_matches(tag_number, '(\\d+)\\s*$') THEN CAST(CAST(regexp_extract(tag_number, '(\\d+)\\s*$', 1) AS BIGINT) AS VARCHAR) ELSE {trim('tag_number')} END AS num,
nullif(upper(regexp_extract(regexp_replace(tag_number, '\\s+', '', 'g'), '^([A-Za-z]+)0*(\\d+)$', 1)), '') AS prefix FROM extracted_tags WHERE tag_type IN ('spool', 'weld')""")
def fn_tag_numbers(spark, d):
    t = F.col("tag_number")
    return tags(spark, d).filter(F.col("tag_type").isin("spool", "weld")).select("id", T.trailing_number(t).alias("num"), T.tag_parts(t)["prefix"].alias("prefix"))


@query("SELECT id, sha256(page_text) AS content_hash, length(page_text) AS chars FROM document_pages")
def fn_content_hash(spark, d):
    return table(spark, d, "document_pages").select("id", F.sha2("page_text", 256).alias("content_hash"), F.length("page_text").cast("bigint").alias("chars"))


@query(f"""SELECT id, nullif(array_to_string(list_filter(list_transform(regexp_split_to_array(page_text, '\\r?\\n'), lambda x: {trim('x')}), lambda x: x <> ''), ' / '), '') AS cell FROM document_pages""")
def fn_cells(spark, d):
    return table(spark, d, "document_pages").select("id", T.cell(F.col("page_text")).alias("cell"))


@query(f"SELECT id, {cases(low('category'), K.VALVES)} AS valve FROM valve_matches")
def cls_valves(spark, d):
    return table(spark, d, "valve_matches").select("id", K.valve(F.col("category")).alias("valve"))


_CT, _TX = low("component_type"), f"({low('component_type')} || ' ' || {low('description')})"
FITTING_SQL = f"""CASE WHEN regexp_matches({_TX}, {q(K.FASTENERS)}) OR contains({_CT}, 'support') OR regexp_matches({_TX}, '\\bsupport\\b') THEN NULL WHEN regexp_matches({_TX}, {q(K.EXPANSION)}) THEN 'expansion joints'
WHEN contains({_TX}, 'valve') AND NOT regexp_matches({_TX}, {q(K.ACCESSORIES)}) THEN 'valves' WHEN contains({_CT}, 'instrument') OR (regexp_matches({_TX}, '\\bpipe\\b') AND NOT regexp_matches({_TX}, {q(K.PIPE_PARTS)})) THEN NULL
{' '.join(f'WHEN regexp_matches({_TX}, {q(p)}) THEN {q(n)}' for n, p in K.FITTINGS)} WHEN contains({_CT}, 'fitting') THEN 'other fittings' END"""
BOM_CATEGORY_SQL = f"CASE WHEN regexp_matches({_TX}, {q(K.BOM_EXCLUDED)}) THEN NULL {' '.join(f'WHEN regexp_matches({_TX}, {q(p)}) THEN {q(c)}' for c, h, p in K.BOM)} END"
BOM_HINT_SQL = f"CASE WHEN regexp_matches({_TX}, {q(K.BOM_EXCLUDED)}) THEN NULL {' '.join(f'WHEN regexp_matches({_TX}, {q(p)}) THEN {q(h)}' for c, h, p in K.BOM)} END"


@query(f"SELECT id, {FITTING_SQL} AS fitting, {BOM_CATEGORY_SQL} AS category, {BOM_HINT_SQL} AS hint, CASE WHEN contains({_CT}, 'pipe') AND NOT contains({_CT}, 'support') THEN 'pipes' WHEN contains({_CT}, 'fitting') THEN 'fittings' WHEN contains({_CT}, 'flange') THEN 'flanges' WHEN contains({_CT}, 'valve') THEN 'valves' END AS spec_array FROM bom_rows")
def cls_bom(spark, d):
    c, t = F.col("component_type"), F.col("description")
    b = K.bom(c, t)
    return table(spark, d, "bom_rows").select("id", K.fitting(c, t).alias("fitting"), b["category"].alias("category"), b["hint"].alias("hint"), K.spec_array(c).alias("spec_array"))


@query(f"""SELECT id, CASE WHEN regexp_matches(upper(tag_number), '^(?:SW|BW)') THEN 'shop' WHEN regexp_matches(upper(tag_number), '^FW') THEN 'field' END AS place,
CASE WHEN regexp_matches(lower(location_note), '\\b(?:bw|sw|fw)\\s*0*\\d+\\b') THEN 'weld' WHEN regexp_matches(lower(location_note), '\\bvalves?\\b') OR regexp_extract(lower(location_note), '\\bitem\\s*(\\d+)\\b', 1) IN ('7', '13', '14', '19') THEN 'valve'
{' '.join(f'WHEN regexp_matches(lower(location_note), {q(p)}) THEN {q(n)}' for n, p in K.ENDS)} END AS end_kind FROM {bag('b', ['location_note'], "tag_type = 'weld'")}""")
def cls_welds(spark, d):
    t = tags(spark, d, "weld", fields=["location_note"])
    return t.select("id", K.weld_place(F.col("tag_number")).alias("place"), K.dimension_end(F.col("location_note")).alias("end_kind"))
