"""Valve match by class, quality flags, container fit and class tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as T
from ..operators import crosscheck as C
from ..operators import quality as Q
from ..operators import spools
from ..runtime import table
from . import scalar_queries as X
from .crosscheck_queries import CLASSES
from .scalar_queries import bag, blank, key, q, tags, trim

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


_STEM = lambda v: f"CASE WHEN NOT {blank(v)} THEN CASE WHEN regexp_extract({key(v)}, '^([A-Z]{{2}}\\d{{2}}[A-Z]?)(?:[-\\s].*)?$', 1) <> '' THEN regexp_extract({key(v)}, '^([A-Z]{{2}}\\d{{2}}[A-Z]?)(?:[-\\s].*)?$', 1) ELSE {key(v)} END END"
_BOM = bag("b", ["line_number", "component_type", "description", "item_spec_class", "size", "quantity"], "tag_type = 'bom_item'")
_PID = bag("b", ["line_number", "valve_type", "spec_class", "size", "quantity"], "tag_type = 'valve' AND doc_type = 'pid'")
_VSIDE = lambda src, spec, kind, detail: f"SELECT project_id, {key('line_number')} AS line, coalesce({_STEM(spec)}, 'unassigned') AS spec_class, {X.cases(X.low(kind), K.VALVES)} AS category, {X.dn('size')} AS dn, coalesce({X.num('quantity')}, 1) AS qt, {detail} AS d, id FROM {src}"
_VG = "project_id, line, spec_class, category, dn"


def _vagg(name: str) -> str:
    return f"(SELECT {_VG}, sum(qt) AS n, list(d ORDER BY id) FILTER (WHERE d <> '') AS ds FROM (SELECT {_VG}, d, sum(qt) AS qt, min(id) AS id FROM {name} WHERE category IS NOT NULL GROUP BY ALL) GROUP BY ALL)"


@query(f"""WITH vi AS ({_VSIDE(_BOM, 'item_spec_class', "(coalesce(component_type, '') || ' ' || coalesce(description, ''))", trim("string_split(coalesce(description, ''), ',')[1]"))}),
vp AS ({_VSIDE(_PID, 'spec_class', 'valve_type', f"CASE WHEN {trim("coalesce(tag_number, '')")} = '' THEN 'untagged' ELSE {trim('tag_number')} END")}),
a AS {_vagg('vi')}, b AS {_vagg('vp')},
j AS (SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.line, b.line) AS line, coalesce(a.spec_class, b.spec_class) AS spec_class, coalesce(a.category, b.category) AS category, coalesce(a.dn, b.dn) AS dn, coalesce(a.n, 0) AS iso_count, coalesce(b.n, 0) AS pid_count,
CASE WHEN a.n IS NOT NULL THEN array_to_string(coalesce(a.ds, []), ' / ') END AS iso_detail, CASE WHEN b.n IS NOT NULL THEN coalesce(nullif(array_to_string(list_filter(b.ds, lambda x: x <> 'untagged'), ' / '), ''), 'untagged') END AS pid_detail
FROM a FULL JOIN b ON a.project_id IS NOT DISTINCT FROM b.project_id AND a.line IS NOT DISTINCT FROM b.line AND a.spec_class = b.spec_class AND a.category = b.category AND a.dn IS NOT DISTINCT FROM b.dn),
s AS (SELECT *, CASE WHEN iso_count > 0 AND pid_count = 0 THEN 'iso only' WHEN pid_count > 0 AND iso_count = 0 THEN 'pid only' WHEN iso_count = pid_count THEN 'match' ELSE 'count mismatch' END AS status FROM j)
SELECT *, sum(iso_count) OVER w AS iso_total, sum(pid_count) OVER w AS pid_total, row_number() OVER (PARTITION BY project_id, line, spec_class ORDER BY list_position({list(Q.STATUSES)}, status), category, dn NULLS LAST) AS place, dense_rank() OVER (PARTITION BY project_id, line ORDER BY spec_class = 'unassigned', spec_class) AS class_place FROM s WINDOW w AS (PARTITION BY project_id, line, spec_class)""")
def check_valve_match(spark, d):
    """Valves of the isometrics' bills and the diagrams of a line by class, kind and size, in the order they are shown."""
    line = T.tag_key(F.col("line_number")).alias("line")
    bom = tags(spark, d, "bom_item", fields=["line_number", "component_type", "description", "item_spec_class", "size", "quantity"]).select("project_id", line, "id", "component_type", "description", "item_spec_class", "size", "quantity")
    pid = tags(spark, d, "valve", "pid", ["line_number", "valve_type", "spec_class", "size", "quantity"]).select("project_id", line, "id", "valve_type", "spec_class", "size", "quantity", "tag_number")
    return Q.valve_match(bom, pid, ["project_id", "line"])


_PG = "coalesce(source_page, 0) AS page"
_W = f"w AS (SELECT id, document_id, {_PG}, tag_number, spool_no, weld_type, size, weld_list_id, location_note FROM {bag('b', ['spool_no', 'weld_type', 'size', 'weld_list_id', 'location_note'], "tag_type = 'weld'")})"
_KEYS = ["document_id", "page"]


def _paged(spark, d, kind: str, fields: list[str]) -> DataFrame:
    return tags(spark, d, kind, fields=fields).withColumn("page", F.coalesce("source_page", F.lit(0)))


def _welds(spark, d) -> DataFrame:
    return _paged(spark, d, "weld", ["spool_no", "weld_type", "size", "weld_list_id", "location_note"])


@query(f"""WITH {_W}, s AS (SELECT id, document_id, {_PG}, tag_number, boundary_note FROM {bag('b', ['boundary_note'], "tag_type = 'spool'")}),
f AS (SELECT document_id, page, spool_no, count(*) AS n FROM w WHERE lower(weld_type) = 'field weld' AND spool_no <> '' GROUP BY ALL)
SELECT id, 'branch boundary' AS flag, NULL AS a FROM s WHERE regexp_matches(boundary_note, {q(spools.BRANCH)}) AND regexp_matches(boundary_note, {q(spools.BOUND)})
UNION ALL SELECT id, 'through valve', NULL FROM s WHERE regexp_matches(boundary_note, {q(spools.PASS_THROUGH)})
UNION ALL SELECT s.id, 'field welds', CAST(n AS VARCHAR) FROM s JOIN f ON f.document_id = s.document_id AND f.page = s.page AND f.spool_no = s.tag_number WHERE n > 1""")
def check_spool_flags(spark, d):
    """Doubts about the spools of every sheet."""
    s = _paged(spark, d, "spool", ["boundary_note"]).select("id", *_KEYS, F.col("tag_number").alias("spool_no"), F.col("boundary_note").alias("note"))
    return Q.spool_flags(s, _welds(spark, d), _KEYS)


@query(f"""WITH {_W}, r0 AS (SELECT id, document_id, {_PG}, {trim('tag_number')} AS k, nd, type FROM {bag('b', ['nd', 'type'], "tag_type = 'weld_list_row'")}),
r AS (SELECT document_id, page, k, arg_max(struct_pack(nd := nd, ty := type), id) AS r FROM r0 GROUP BY ALL),
j AS (SELECT w.id, coalesce(r.nd <> '' AND w.size <> '' AND {trim('r.nd')} <> {trim('w.size')}, false) AS size_differs, coalesce(r.ty <> '' AND weld_type <> '' AND contains(lower(r.ty), 'field') <> contains(lower(weld_type), 'field'), false) AS place_differs FROM w JOIN r ON r.document_id = w.document_id AND r.page = w.page AND r.k = {trim('w.weld_list_id')} WHERE weld_list_id <> '')
SELECT * FROM j WHERE size_differs OR place_differs""")
def check_weld_list_flags(spark, d):
    """Welds that disagree with the row of the weld list they cite on their sheet."""
    rows = _paged(spark, d, "weld_list_row", ["nd", "type"]).select("id", *_KEYS, F.col("tag_number").alias("number"), "nd", "type")
    return Q.weld_list_flags(_welds(spark, d), rows, _KEYS)


@query(f"""WITH d0 AS (SELECT id, document_id, upper(regexp_replace(axis, '\\s', '', 'g')) AS ax, CASE WHEN regexp_matches(spool_no, '(\\d+)\\s*$') THEN CAST(CAST(regexp_extract(spool_no, '(\\d+)\\s*$', 1) AS BIGINT) AS VARCHAR) ELSE {trim('spool_no')} END AS spool, TRY_CAST(value_mm AS DOUBLE) AS v FROM {bag('b', ['axis', 'spool_no', 'value_mm'], "tag_type = 'dimension'")} WHERE {trim('spool_no')} <> ''),
s AS (SELECT document_id, spool, ax, sum(v) AS v FROM d0 WHERE ax IN ('E', 'N', 'EL') AND v > 0 GROUP BY ALL),
b AS (SELECT document_id, spool, coalesce(max(v) FILTER (WHERE ax = 'E'), 0) AS e, coalesce(max(v) FILTER (WHERE ax = 'N'), 0) AS n, coalesce(max(v) FILTER (WHERE ax = 'EL'), 0) AS el, max(v) AS summed FROM s GROUP BY ALL),
x AS (SELECT *, list_sort([e, n, el], 'DESC') AS box FROM b)
SELECT document_id, spool, e, n, el, summed, CASE {' '.join(f"WHEN box[1] <= {c[0]} AND box[2] <= {c[1]} AND box[3] <= {c[2]} THEN {q(n)}" for n, c in Q.CONTAINERS)} ELSE 'oversized' END AS container FROM x""")
def check_container_sums(spark, d):
    """Envelopes of spools from their dimensions and the first container that holds each; dimensions here name no ends, so none is shared."""
    dims = tags(spark, d, "dimension", fields=["axis", "spool_no", "value_mm", "from_ref", "to_ref"]).select("document_id", "id", "spool_no", "axis", F.col("value_mm").alias("value"), "from_ref", "to_ref", F.lit(False).alias("excluded"))
    points = tags(spark, d, "route_point", fields=["spool_no", "easting_mm", "northing_mm", "elevation_mm"])
    points = points.select("document_id", "spool_no", *[F.regexp_replace(T.trimmed(F.col(c)), r"^\+", "").try_cast("double").alias(a) for c, a in (("easting_mm", "e"), ("northing_mm", "n"), ("elevation_mm", "el"))]).dropna()
    return Q.container_fit(dims, points, ["document_id"]).select("document_id", "spool", "e", "n", "el", "summed", "container")


_MEND = f"""m0 AS (SELECT *, coalesce(lo > hi, false) AS bad, {trim('size_min')} || ' ' || {trim('size_max')} AS bt FROM cr),
m AS (SELECT class_code, category, pos, CASE category WHEN 'flanges' THEN label || '|' || rating WHEN 'pipes' THEN '' ELSE label END AS grp, CASE WHEN bad THEN bt ELSE size_min END AS size_min, CASE WHEN bad THEN bt ELSE size_max END AS size_max, CASE WHEN bad THEN {X.nps('bt')} ELSE lo END AS lo, CASE WHEN bad THEN {X.nps('bt')} ELSE hi END AS hi, bad AS repaired, txt FROM m0)"""


@query(f"WITH {CLASSES}, {_MEND} SELECT class_code, category, pos, repaired, row_number() OVER (PARTITION BY class_code, category ORDER BY f, lo NULLS LAST, pos) AS place FROM (SELECT *, min(pos) OVER (PARTITION BY class_code, category, grp) AS f FROM m)")
def win_sorted_rows(spark, d):
    """Rows of every class in the order they are shown: types as first seen, sizes rising, those without a size last."""
    return Q.sorted_rows(Q.mended_rows(C.class_table(table(spark, d, "extracted_tags")))).select("class_code", "category", "pos", "repaired", "place")


_LABEL = "(CASE WHEN category = 'pipes' THEN 'Pipe' WHEN grp = '' THEN category ELSE grp END || ' ' || CASE WHEN size_min IS NOT DISTINCT FROM size_max THEN coalesce(size_min, '?') ELSE coalesce(size_min, '?') || '-' || coalesce(size_max, '?') END || CASE WHEN txt <> '' THEN ' (' || txt || ')' ELSE '' END)"


@query(f"""WITH {CLASSES}, {_MEND}, b AS (SELECT *, {_LABEL} AS lab, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN struct_pack(hi := hi, pos := pos, lab := {_LABEL}) END AS sp FROM m WHERE category <> 'valves'),
o AS (SELECT *, last_value(sp IGNORE NULLS) OVER (PARTITION BY class_code, category, grp ORDER BY lo NULLS LAST, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM b)
SELECT class_code, category, grp AS "group", pos, pv.pos AS before, pv.lab || ' overlaps ' || lab AS issue FROM o WHERE lo IS NOT NULL AND hi IS NOT NULL AND lo <= pv.hi + 1e-9""")
def win_overlaps(spark, d):
    """Class rows whose size range overlaps the one before in their group of types."""
    return Q.overlapping(Q.mended_rows(C.class_table(table(spark, d, "extracted_tags"))))


@query(f"SELECT project_id, coalesce({_STEM('spec_class')}, 'unassigned') AS spec_class, sum(coalesce({X.num('quantity')}, 1)) AS valves FROM {_PID} GROUP BY ALL")
def agg_valves_by_class(spark, d):
    """Valves on the diagrams by class."""
    v = tags(spark, d, "valve", "pid", ["spec_class", "quantity"])
    return v.groupBy("project_id", F.coalesce(T.class_stem(F.col("spec_class")), F.lit("unassigned")).alias("spec_class")).agg(F.sum(F.coalesce(T.number(F.col("quantity")), F.lit(1.0))).alias("valves"))


@query(f"""WITH v AS ({_VSIDE(_PID, 'spec_class', 'valve_type', "''")}) SELECT project_id, category, sum(qt) AS valves FROM v WHERE category IS NOT NULL GROUP BY ALL""")
def agg_valve_tally(spark, d):
    """Valves on the diagrams by kind."""
    v = tags(spark, d, "valve", "pid", ["valve_type", "quantity"]).withColumn("category", K.valve(F.col("valve_type"))).filter("category is not null")
    return v.groupBy("project_id", "category").agg(F.sum(F.coalesce(T.number(F.col("quantity")), F.lit(1.0))).alias("valves"))


@query(f"""WITH {_W}, n AS (SELECT *, TRY_CAST(regexp_extract(tag_number, '(\\d+)\\s*$', 1) AS BIGINT) AS num, upper(regexp_extract({trim('tag_number')}, '^([A-Za-z]*)', 1)) AS prefix FROM w)
SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY page, prefix, num NULLS LAST, id) AS place FROM n""")
def win_weld_order(spark, d):
    """Welds of a document in natural order: page, prefix, number."""
    from pyspark.sql.window import Window

    w = _welds(spark, d).withColumn("prefix", F.upper(F.regexp_extract(T.trimmed(F.col("tag_number")), "^([A-Za-z]*)", 1))).withColumn("num", F.regexp_extract("tag_number", r"(\d+)\s*$", 1).try_cast("bigint"))
    return w.select("id", F.row_number().over(Window.partitionBy("document_id").orderBy("page", "prefix", F.col("num").asc_nulls_last(), "id")).alias("place"))
