"""Cross-checks of bill rows, item lists and valves against piping classes, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import sizes as S
from ..functions import text as T
from ..operators import crosscheck as C
from ..operators import shred
from ..runtime import table
from . import scalar_queries as X
from .scalar_queries import q, tags, trim

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


_ELEMS = "CASE json_type(f) WHEN 'ARRAY' THEN CAST(f AS JSON[]) WHEN 'OBJECT' THEN [f] WHEN 'VARCHAR' THEN CASE WHEN json_valid(f ->> '$') THEN CASE json_type(CAST(f ->> '$' AS JSON)) WHEN 'ARRAY' THEN CAST(CAST(f ->> '$' AS JSON) AS JSON[]) WHEN 'OBJECT' THEN [CAST(f ->> '$' AS JSON)] END END END"
_J = lambda *names: "coalesce(" + ", ".join(f"v ->> '$.{n}'" for n in names) + ", '')"
#: ks: all classes; cr: the rows of the richest tag of each.
CLASSES = f"""tg AS (SELECT id, {X.bom_class('tag_number')} AS class_code FROM extracted_tags WHERE tag_type = 'spec_class'),
x AS MATERIALIZED ({' UNION ALL '.join(f"SELECT id, '{c}' AS category, CAST(attributes AS JSON) -> '$.{c}' AS f FROM extracted_tags WHERE tag_type = 'spec_class' AND json_valid(attributes)" for c in C.CATEGORIES)}),
y AS MATERIALIZED (SELECT id, category, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS v FROM (SELECT *, {_ELEMS} AS a FROM x)),
nn AS (SELECT id, count(*) AS n FROM y WHERE json_type(v) = 'OBJECT' GROUP BY id),
ks AS (SELECT class_code, arg_max(tg.id, (coalesce(n, 0), -tg.id)) AS tag_id FROM tg LEFT JOIN nn USING (id) WHERE class_code IS NOT NULL GROUP BY class_code),
cr AS (SELECT ks.class_code, category, pos, {_J('fitting_type', 'flange_type', 'valve_type', 'description')} AS label, v ->> '$.size_min' AS size_min, v ->> '$.size_max' AS size_max,
{X.nps("(v ->> '$.size_min')")} AS lo, {X.nps("(v ->> '$.size_max')")} AS hi, {trim(_J('class'))} AS rating, {trim(_J('end_type'))} AS end_type, {trim(_J('schedule'))} AS schedule, {trim(_J('description', 'material'))} AS txt
FROM y JOIN ks ON ks.tag_id = y.id WHERE json_type(v) = 'OBJECT')"""
_EX = "CASE hint WHEN 'blind' THEN contains(lower(label), 'spectacle') WHEN 'flange' THEN contains(lower(label), 'blind') OR contains(lower(label), 'orifice') ELSE false END"
_TYPED = f"(hint = '' OR (contains(lower(label), hint) AND NOT ({_EX})))"
_DNS = ", ".join(map(str, S.DN_TO_NPS))
_KNOWN = lambda v: f"(CASE WHEN CAST(floor(TRY_CAST({trim(v)} AS DOUBLE) + 0.5) AS BIGINT) IN ({_DNS}) THEN floor(TRY_CAST({trim(v)} AS DOUBLE) + 0.5) END)"


def _classes(spark, d):
    return C.class_table(table(spark, d, "extracted_tags"))


def _bom(spark, d) -> DataFrame:
    dn = S.dn(F.col("size"))
    known = F.when(S.nps_of_dn(dn.cast("string")).isNotNull(), dn.cast("double"))
    hint = C.bom_hint(K.bom(F.col("component_type"), F.col("description")))
    return table(spark, d, "bom_rows").select("id", T.bom_class(F.col("spec_class")).alias("class_code"), hint.alias("hint"), known.alias("dn"))


_BOM = f"""b AS (SELECT id, {X.bom_class('spec_class')} AS class_code, {X.BOM_CATEGORY_SQL} AS category, {X.BOM_HINT_SQL} AS hint, CASE WHEN {X.dn('size')} IN ({_DNS}) THEN CAST({X.dn('size')} AS DOUBLE) END AS dn FROM bom_rows),
bh AS (SELECT b.id, min(pos) AS pos FROM b JOIN cr USING (class_code, category) WHERE {_TYPED} AND lo - 1e-9 <= dn AND dn <= hi + 1e-9 GROUP BY b.id),
bv AS (SELECT b.id, b.class_code, b.category, CASE WHEN b.category IS NULL THEN 'out_of_scope' WHEN ks.class_code IS NULL THEN 'class_not_found' WHEN dn IS NULL THEN 'size_unrecognized'
WHEN NOT EXISTS (SELECT 1 FROM cr WHERE cr.class_code = b.class_code AND cr.category = b.category) THEN 'no_client_data' WHEN pos IS NULL THEN 'not_found' ELSE 'match' END AS verdict, pos
FROM b LEFT JOIN ks USING (class_code) LEFT JOIN bh USING (id))"""


@query(f"WITH {CLASSES}, {_BOM} SELECT id, verdict, CASE WHEN verdict = 'match' THEN pos END AS pos FROM bv")
def check_bom_rows(spark, d):
    """Verdict of every bill row against its class: the first row of its type whose range holds its size."""
    return C.check_bom(_bom(spark, d), _classes(spark, d)).select("id", "verdict", "pos")


_HINTS = ", ".join(f"({q(k)}, {q(v[0])}, {q(v[1])}, {v[3]}, {v[4]})" for k, v in C.TYPE_CODES.items())
_SUB = "CASE type " + " ".join(f"WHEN {q(k)} THEN list_sort(list_filter([{', '.join(f'''{{'at': strpos(lower(text), {q(w)}), 'h': {q(h)}}}''' for w, h in v[5])}], lambda s: s.at > 0))[1].h" for k, v in C.TYPE_CODES.items() if v[5]) + " END"
_RATE = f"coalesce(nullif(regexp_extract(text, {q(T.CLASS_RATING)}, 1), ''), nullif(regexp_extract(text, {q(T.CLASS_RATING)}, 2), ''))"


def _items_sql(code: str, where: str = "true") -> str:
    """iv: items with the positions of each stage; ip: items beside the rows of their class."""
    return f"""h(type, category, base, branch, optional) AS (VALUES {_HINTS}),
    i0 AS (SELECT id, type, {code} AS class_code, coalesce(description, '') || ' ' || coalesce(material, '') AS text, {_KNOWN('size_p1')} AS dn FROM sheet_items WHERE {where}),
    i1 AS (SELECT *, {_SUB} AS sub FROM i0),
    it AS (SELECT i1.*, h.category, coalesce(sub, base) AS hint, sub IS NOT NULL AS narrowed, branch, optional FROM i1 LEFT JOIN h USING (type)),
    ip AS (SELECT it.id, it.class_code, it.category, cr.pos, label, {_TYPED.replace(_EX, f"NOT narrowed AND ({_EX})")} AS typed, coalesce(lo - 1e-9 <= dn AND dn <= hi + 1e-9, false) AS fits, dn IS NULL AS unsized, rating = '' OR {_RATE} IS NULL OR {_RATE} = rating AS rated FROM it JOIN cr USING (class_code, category)),
    ia AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE typed) AS nt, min(pos) FILTER (WHERE typed AND (unsized OR fits) AND rated) AS p1, min(pos) FILTER (WHERE typed AND (unsized OR fits)) AS p2, min(pos) FILTER (WHERE fits AND rated) AS p3, arg_min(label, pos) FILTER (WHERE typed) AS first_label FROM ip GROUP BY id),
    iv AS (SELECT it.*, ks.class_code IS NOT NULL AS known, n, nt, p1, p2, CASE WHEN NOT branch AND dn IS NOT NULL AND nt = 0 THEN p3 END AS p3, first_label FROM it LEFT JOIN ks USING (class_code) LEFT JOIN ia USING (id))"""


_RAW = f"CASE WHEN coalesce({trim('spec_code')}, '') = '' THEN (SELECT min(class_code) FROM ks) ELSE upper({trim('spec_code')}) END"


@query(f"""WITH {CLASSES}, {_items_sql(_RAW)}, w AS (SELECT id, type, CASE WHEN hint IS NULL THEN 'out_of_scope' WHEN NOT known THEN 'class_not_found' WHEN dn IS NULL AND NOT optional THEN 'size_unrecognized' WHEN n IS NULL THEN 'no_client_data' WHEN p2 IS NOT NULL THEN 'match' WHEN p3 IS NOT NULL THEN 'mismatch' ELSE 'not_found' END AS verdict, p1, p2, p3, hint FROM iv)
SELECT id, verdict, CASE verdict WHEN 'match' THEN coalesce(p1, p2) WHEN 'mismatch' THEN p3 END AS pos, CASE WHEN hint IS NULL THEN CASE type {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.OUT_OF_SCOPE.items())} END END AS note FROM w""")
def check_items(spark, d):
    """Verdict of every item of the item lists against the class its code names as printed; a blank code takes the first class."""
    classes = _classes(spark, d)
    first = classes.agg(F.min("class_code")).first()[0]
    code = T.trimmed(F.coalesce("spec_code", F.lit("")))
    items = table(spark, d, "sheet_items").select("id", F.when(code == "", F.lit(first)).otherwise(F.upper(code)).alias("class_code"), "type", "description", "material", "size_p1", "size_p2")
    return C.check_items(items, classes)


_CODE = f"regexp_replace(upper({trim('spec_code')}), '^([A-Z]+\\d+[A-Z])1$', '\\1')"
_SUBST = f"""{_items_sql(_CODE, f"coalesce({trim('spec_code')}, '') <> ''")},
su AS (SELECT ip.id, ip.class_code, ip.category, ip.pos, ip.label FROM ip JOIN iv USING (id) WHERE (iv.dn IS NOT NULL OR optional) AND CASE WHEN p1 IS NOT NULL THEN ip.typed AND (unsized OR fits) AND rated WHEN p2 IS NOT NULL THEN ip.typed AND (unsized OR fits) ELSE p3 IS NOT NULL AND fits AND rated END
UNION ALL SELECT id, class_code, category, NULL, coalesce(nullif({trim('first_label')}, ''), 'Other') FROM iv WHERE p2 IS NULL AND nt > 0 AND dn IS NOT NULL)"""


def _substantiated(spark, d, classes: DataFrame) -> DataFrame:
    items = table(spark, d, "sheet_items").filter(T.trimmed(F.coalesce("spec_code", F.lit(""))) != "")
    return C.substantiated(items.select("id", T.class_code(F.col("spec_code")).alias("class_code"), "type", "description", "material", "size_p1", "size_p2"), classes)


@query(f"WITH {CLASSES}, {_SUBST} SELECT id, class_code, category, pos, label FROM su")
def join_items_to_rows(spark, d):
    """Every class row that an item could stand for; pos null where the class has its type but not its size. Items without a code belong to no class here."""
    return _substantiated(spark, d, _classes(spark, d))


@query(f"WITH {CLASSES}, {_SUBST} SELECT class_code, category, label, count(*) AS items FROM su WHERE pos IS NULL GROUP BY ALL")
def agg_unmatched_sizes(spark, d):
    """Items whose size their class lacks, by the class's own type."""
    return _substantiated(spark, d, _classes(spark, d)).filter("pos is null").groupBy("class_code", "category", "label").agg(F.count("*").alias("items"))


_SHOWN = f"CASE WHEN category = 'pipes' THEN 'Pipe' WHEN label = '' THEN '-' ELSE label END AS ty, CASE WHEN end_type = '' THEN '-' ELSE end_type END AS en, CASE category WHEN 'pipes' THEN CASE WHEN schedule = '' THEN '-' ELSE schedule END WHEN 'fittings' THEN {q(C.FITTING_RATING)} ELSE CASE WHEN rating = '' THEN '-' ELSE rating END END AS ra, CASE WHEN txt = '' THEN '-' ELSE txt END AS tx"
_BANDS = f"""bs AS (SELECT *, {_SHOWN} FROM cr),
bg AS (SELECT *, CASE WHEN lag(ty) OVER w = ty AND lag(en) OVER w = en AND lag(ra) OVER w = ra AND lag(tx) OVER w = tx THEN 0 ELSE 1 END AS nw FROM bs WINDOW w AS (PARTITION BY class_code, category ORDER BY pos)),
bi AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY class_code, category ORDER BY pos) - 1 AS INTEGER) AS band FROM bg),
bd AS (SELECT class_code, category, band, any_value(ty) AS type, any_value(en) AS end_type, any_value(ra) AS rating, any_value(tx) AS text, arg_min(size_min, pos) AS size_min, arg_max(size_max, pos) AS size_max, arg_min(lo, pos) AS lo, arg_max(hi, pos) AS hi, list(pos ORDER BY pos) AS positions FROM bi GROUP BY ALL)"""


@query(f"""WITH {CLASSES}, {_BANDS} SELECT class_code, category, band, type, end_type, rating, text, CASE WHEN size_min IS NOT NULL AND size_max IS NOT NULL THEN CASE WHEN size_min = size_max THEN size_min ELSE size_min || '–' || size_max END ELSE coalesce(size_min, size_max, '-') END AS size, array_to_string(positions, ',') AS positions FROM bd""")
def win_bands(spark, d):
    """Adjacent class rows that show the same as one band, with the positions it is made of."""
    b = C.class_bands(_classes(spark, d))
    return b.select("class_code", "category", "band", "type", "end_type", "rating", "text", S.range_label(F.col("size_min"), F.col("size_max")).alias("size"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


_MATCHED = f"""{_SUBST}, {_BANDS}, bp AS (SELECT *, unnest(positions) AS pos FROM bd),
bm AS (SELECT DISTINCT su.id, bp.class_code, bp.category, bp.band FROM su JOIN bp ON bp.class_code = su.class_code AND bp.category = su.category AND bp.pos = su.pos)"""


def _band_items(spark, d) -> DataFrame:
    classes = _classes(spark, d)
    spots = C.class_bands(classes).select("class_code", "category", "band", "rating", "end_type", "text", S.nps(F.col("size_min")).alias("lo"), S.nps(F.col("size_max")).alias("hi"), F.explode("positions").alias("pos"))
    once = _substantiated(spark, d, classes).filter("pos is not null").select("id", "class_code", "category", "pos").join(spots, ["class_code", "category", "pos"]).drop("pos").distinct()
    text = F.concat(F.coalesce("description", F.lit("")), F.lit(" "), F.coalesce("material", F.lit("")))
    items = table(spark, d, "sheet_items").select("id", text.alias("item_text"), C.known_dn(F.col("size_p1")).alias("item_dn"))
    return C.compare_fields(once.join(items, "id"))


_LIST = lambda col, p: f"list_transform(regexp_extract_all({col}, {q(p)}), lambda t: upper(regexp_replace(t, '\\s+', '', 'g')))"
_STD = lambda col: "list_distinct(" + " || ".join(_LIST(col, p) for p in T.STANDARDS) + ")"
_END = f"coalesce(list_filter({_LIST('t', T.END_TYPE)}, lambda x: x <> 'RF')[1], {_LIST('t', T.END_TYPE)}[1])"
_TOLD = f"CASE WHEN category = 'pipes' THEN nullif(upper(regexp_extract(t, {q(T.SCHEDULE)}, 1)), '') ELSE coalesce(nullif(regexp_extract(t, {q(T.CLASS_RATING)}, 1), ''), nullif(regexp_extract(t, {q(T.CLASS_RATING)}, 2), '')) END"
_BARE = lambda v: f"regexp_replace(upper({v}), '^0+(\\d)', '\\1')"
_SAY = lambda unknown, same: f"CASE WHEN coalesce({unknown}, true) THEN 'unknown' WHEN {same} THEN 'match' ELSE 'differs' END"
_COMPARED = f"""{_MATCHED}, cp AS (SELECT bm.id, bm.class_code, bm.category, bm.band, bd.rating, bd.end_type, bd.text, bd.lo, bd.hi, coalesce(s.description, '') || ' ' || coalesce(s.material, '') AS t, {_KNOWN('s.size_p1')} AS x FROM bm JOIN bd USING (class_code, category, band) JOIN sheet_items s ON s.id = bm.id),
ct AS (SELECT *, {_LIST('t', T.GRADE)} AS g1, {_LIST('text', T.GRADE)} AS g2, {_STD('t')} AS s1, {_STD('text')} AS s2, {_TOLD} AS told, rating IN ('', '-', {q(C.FITTING_RATING)}) AS bare, {_END} AS e FROM cp),
cf AS (SELECT id, class_code, category, band, unnest([{{'field': 'Size', 'verdict': {_SAY('x IS NULL OR lo IS NULL OR hi IS NULL', 'lo - 1e-9 <= x AND x <= hi + 1e-9')}}}, {{'field': 'Material', 'verdict': {_SAY('len(g1) = 0 OR len(g2) = 0', 'list_has_any(g1, g2)')}}},
{{'field': 'Schedule / Class', 'verdict': {_SAY('told IS NULL OR bare', f"{_BARE('told')} = {_BARE('rating')}")}}}, {{'field': 'End Type', 'verdict': {_SAY("e IS NULL OR end_type = '-'", 'e = upper(end_type)')}}}, {{'field': 'Standard', 'verdict': {_SAY('len(s1) = 0 OR len(s2) = 0', 'list_has_any(s1, s2)')}}}]) AS f FROM ct)"""


@query(f"WITH {CLASSES}, {_COMPARED} SELECT id, class_code, category, band, f.field AS field, f.verdict AS verdict FROM cf")
def check_item_fields(spark, d):
    """Each item beside each band it could stand for, field by field."""
    return _band_items(spark, d).select("id", "class_code", "category", "band", F.inline("fields")).select("id", "class_code", "category", "band", "field", "verdict")


@query(f"WITH {CLASSES}, {_COMPARED} SELECT class_code, category, band, count(*) AS items, count(*) FILTER (WHERE bad) AS mismatches FROM (SELECT id, class_code, category, band, bool_or(f.verdict = 'differs') AS bad FROM cf GROUP BY ALL) GROUP BY ALL")
def agg_band_matches(spark, d):
    """Items of each band, each once, and those of which any field differs."""
    bad = F.exists("fields", lambda f: f["verdict"] == "differs")
    return _band_items(spark, d).groupBy("class_code", "category", "band").agg(F.count("*").alias("items"), F.count_if(bad).alias("mismatches"))


@query(f"WITH {CLASSES}, {_SUBST} SELECT id, label, unnest(['Size', 'Schedule / Class', 'End Type', 'Standard']) AS field, unnest(['differs', 'unknown', 'unknown', 'unknown']) AS verdict FROM su WHERE pos IS NULL")
def check_unmatched_fields(spark, d):
    """Field verdicts of items whose size their class lacks: the size differs, the rest is not known."""
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(v).alias("verdict")) for n, v in (("Size", "differs"), ("Schedule / Class", "unknown"), ("End Type", "unknown"), ("Standard", "unknown"))])
    return _substantiated(spark, d, _classes(spark, d)).filter("pos is null").select("id", "label", F.inline(rows))


@query(f"""WITH {CLASSES}, {_BOM}, {_SUBST}, sr AS (SELECT DISTINCT class_code, category, pos FROM su WHERE pos IS NOT NULL)
SELECT bv.id, bv.class_code, bv.category, bv.pos, sr.pos IS NOT NULL AS confirmed FROM bv LEFT JOIN sr ON sr.class_code = bv.class_code AND sr.category = bv.category AND sr.pos = bv.pos WHERE verdict = 'match'""")
def join_confirmed_bom(spark, d):
    """Matched bill rows and whether an item list stands for their class row too."""
    classes = _classes(spark, d)
    hit = C.check_bom(_bom(spark, d), classes).filter("verdict = 'match'").select("id", "class_code", "category", "pos")
    listed = _substantiated(spark, d, classes).filter("pos is not null").select("class_code", "category", "pos", F.lit(True).alias("confirmed")).distinct()
    return hit.join(listed, ["class_code", "category", "pos"], "left").select("id", "class_code", "category", "pos", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))


_VCLASS = X.bom_class("p[3]")


@query(f"""WITH {CLASSES}, {_SUBST}, vp AS (SELECT id, dn, list_filter(list_transform(string_split({trim('line_number')}, '-'), lambda x: trim(x)), lambda x: x <> '') AS p FROM valve_matches),
vc AS (SELECT id, CASE WHEN len(p) >= 4 AND regexp_matches(p[1], '^[0-9]+$') THEN {_VCLASS} END AS class_code, CASE WHEN dn IN ({_DNS}) THEN CAST(dn AS DOUBLE) END AS x FROM vp),
vh AS (SELECT vc.id, min(pos) AS pos FROM vc JOIN cr USING (class_code) WHERE category = 'valves' AND lo - 1e-9 <= x AND x <= hi + 1e-9 GROUP BY vc.id),
sl AS (SELECT DISTINCT class_code FROM su), sr AS (SELECT DISTINCT class_code, pos FROM su WHERE category = 'valves' AND pos IS NOT NULL),
vv AS (SELECT vc.*, CASE WHEN x IS NULL THEN 'size_unrecognized' WHEN ks.class_code IS NULL THEN 'no_client_data' WHEN pos IS NULL THEN 'not_found' ELSE 'match' END AS status, pos FROM vc LEFT JOIN ks USING (class_code) LEFT JOIN vh USING (id))
SELECT id, class_code, status, CASE WHEN status = 'match' THEN vv.pos END AS pos, CASE WHEN status = 'match' AND EXISTS (SELECT 1 FROM sl WHERE sl.class_code = vv.class_code) THEN EXISTS (SELECT 1 FROM sr WHERE sr.class_code = vv.class_code AND sr.pos = vv.pos) END AS admin FROM vv""")
def check_valve_rows(spark, d):
    """Valves of both sides against the class that their line names: by size alone, with the item list's word on the row."""
    classes = _classes(spark, d)
    v = table(spark, d, "valve_matches").select("id", T.bom_class(T.line_parts(F.col("line_number"))["spec_class"]).alias("class_code"), "dn")
    return C.valve_status(v, classes, _substantiated(spark, d, classes)).select("id", "class_code", "status", "pos", "admin")


_BT = f"""bt AS (SELECT id, document_id, {X.key("json_extract_string(attributes, '$.line_number')")} AS k, json_extract_string(attributes, '$.item_spec_class') AS own, json_extract_string(attributes, '$.component_type') AS component_type, json_extract_string(attributes, '$.description') AS description, json_extract_string(attributes, '$.size') AS size FROM extracted_tags WHERE tag_type = 'bom_item'),
ln AS (SELECT document_id, {X.key('tag_number')} AS k, arg_min(struct_pack(c := coalesce(json_extract_string(attributes, '$.spec_class'), ''), n := CASE WHEN json_valid(attributes) AND json_type(CAST(attributes AS JSON) -> '$.spec_breaks') = 'ARRAY' THEN json_array_length(CAST(attributes AS JSON) -> '$.spec_breaks') ELSE 0 END), id) AS l FROM extracted_tags WHERE tag_type = 'line' AND doc_type = 'iso' GROUP BY ALL),
gb AS (SELECT bt.*, CASE WHEN coalesce({trim('own')}, '') <> '' THEN {trim('own')} WHEN coalesce(l.n, 0) < 2 AND coalesce(l.c, '') <> '' THEN l.c ELSE 'Unassigned' END AS governing FROM bt LEFT JOIN ln ON ln.document_id = bt.document_id AND ln.k = bt.k)"""


@query(f"WITH {CLASSES}, {_BT}, {_BOM.replace('FROM bom_rows', 'FROM (SELECT id, governing AS spec_class, component_type, description, size FROM gb)')} SELECT bv.id, gb.governing, verdict, CASE WHEN verdict = 'match' THEN pos END AS pos FROM bv JOIN gb USING (id)")
def check_bom_tags(spark, d):
    """Items of the isometrics against the class that governs them: their own, else the line's unless it has two breaks or more."""
    b = tags(spark, d, "bom_item", fields=["line_number", "item_spec_class", "component_type", "description", "size"]).withColumn("k", T.tag_key(F.col("line_number")))
    lines = table(spark, d, "extracted_tags").filter("tag_type = 'line' and doc_type = 'iso'")
    breaks = F.coalesce(F.array_size(F.try_variant_get(shred.parse(F.col("attributes")), "$.spec_breaks", "array<variant>")), F.lit(0))
    lines = lines.groupBy("document_id", T.tag_key(F.col("tag_number")).alias("k")).agg(F.min_by(F.struct(F.get_json_object("attributes", "$.spec_class").alias("c"), breaks.alias("n")), "id").alias("l"))
    own, line = T.trimmed(F.coalesce("item_spec_class", F.lit(""))), F.coalesce("l.c", F.lit(""))
    g = b.join(lines, ["document_id", "k"], "left").withColumn("governing", F.when(own != "", own).when((F.coalesce("l.n", F.lit(0)) < 2) & (line != ""), line).otherwise("Unassigned"))
    dn = S.dn(F.col("size"))
    left = g.select("id", "governing", T.bom_class(F.col("governing")).alias("class_code"), C.bom_hint(K.bom(F.col("component_type"), F.col("description"))).alias("hint"), F.when(S.nps_of_dn(dn.cast("string")).isNotNull(), dn.cast("double")).alias("dn"))
    return C.check_bom(left, _classes(spark, d)).select("id", "governing", "verdict", "pos")

