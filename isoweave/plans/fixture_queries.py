"""Operators whose input no table holds, over small rows given in line; the same rows are values of their SQL. Tenancy over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as K
from ..functions import sizes as S
from ..functions import text as T
from ..operators import crosscheck, gates, geometry, spools, tenancy
from ..runtime import table
from ..sources import pages, sinks
from ..streaming import jobs
from . import scalar_queries as X
from . import service_queries as service
from .scalar_queries import bag, key, q, tags, trim

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def given(ddl: str, rows: list[tuple]) -> tuple[Callable[[SparkSession], DataFrame], str]:
    """A frame of the rows and the same rows as a table of SQL values."""
    cols = [c.strip().split(" ", 1) for c in ddl.split(", ")]
    sql_type = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}

    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(map(lit, v)) + "]"
        return q(v) if isinstance(v, str) else repr(v)

    values = ", ".join("(" + ", ".join(f"CAST({lit(v)} AS {sql_type[t]})" for v, (_, t) in zip(r, cols)) + ")" for r in rows)
    names = ", ".join(n for n, _ in cols)
    read = ddl.replace("timestamp", "string")
    stamps = [n for n, t in cols if t == "timestamp"]
    make = lambda spark: spark.createDataFrame(rows, read).withColumns({c: F.col(c).cast("timestamp") for c in stamps})
    return make, f"(SELECT * FROM (VALUES {values}) t({names}))"


# --- geometry --------------------------------------------------------------------------------------

_PAGES, _PAGES_SQL = given("page int, width double, height double", [(1, 1200.0, 800.0), (2, 3.0, 2.0), (3, 0.0, 0.0)])


@query(f"""SELECT page, r + 1 AS row, c + 1 AS col, greatest(0.0, c * width / 3 - width / 3 * 0.08) AS x, greatest(0.0, r * height / 2 - height / 2 * 0.08) AS y, least(width - greatest(0.0, c * width / 3 - width / 3 * 0.08), width / 3 * 1.16) AS w, least(height - greatest(0.0, r * height / 2 - height / 2 * 0.08), height / 2 * 1.16) AS h
FROM {_PAGES_SQL}, range(2) a(r), range(3) b(c)""")
def fx_tiles(spark, d):
    return geometry.tiles(_PAGES(spark))


_MATRICES, _MATRICES_SQL = given("id int, m array<double>, ctm array<double>, x double, y double", [(1, [2.0, 0.0, 0.0, 2.0, 10.0, 20.0], [1.0, 0.0, 0.0, 1.0, 5.0, -5.0], 3.0, 4.0), (2, [0.0, 1.0, -1.0, 0.0, 0.0, 0.0], [2.0, 1.0, 0.5, 3.0, 1.0, 1.0], -2.0, 7.0)])


@query(f"""WITH p AS (SELECT id, x, y, [m[1]*ctm[1]+m[2]*ctm[3], m[1]*ctm[2]+m[2]*ctm[4], m[3]*ctm[1]+m[4]*ctm[3], m[3]*ctm[2]+m[4]*ctm[4], m[5]*ctm[1]+m[6]*ctm[3]+ctm[5], m[5]*ctm[2]+m[6]*ctm[4]+ctm[6]] AS p FROM {_MATRICES_SQL})
SELECT id, p[1]*x+p[3]*y+p[5] AS x, p[2]*x+p[4]*y+p[6] AS y FROM p""")
def fx_affine(spark, d):
    return _MATRICES(spark).select("id", geometry.moved(geometry.multiplied(F.col("m"), F.col("ctm")), F.col("x"), F.col("y")).alias("p")).select("id", "p.*")


def _ring(*points: tuple[float, float]) -> list[list[float]]:
    return [[float(x), float(y)] for x, y in points]


_PATHS = [("d", 1, 1, _ring((10, 0), (0, 10), (-10, 0), (0, -10), (10, 0))), ("d", 1, 2, _ring((0, 0), (16, 10), (16, 5), (16, 0), (0, 10), (0, 0))), ("d", 1, 5, _ring((0, 0), (160, 100), (160, 50), (160, 0), (0, 100), (0, 0))), ("d", 2, 3, _ring((0, 0), (100, 0))), ("d", 2, 4, [])]


@query("SELECT * FROM (VALUES ('d', 1, CAST(1 AS BIGINT), 'weld', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)), ('d', 1, 2, 'valve', 9.6, 5)) t(document_id, page_number, path_id, kind, x, y)")
def fx_symbols(spark, d):
    """A diamond is a weld, a crossing path of valve size a valve; the others are no symbols."""
    return geometry.symbols(spark.createDataFrame(_PATHS, "document_id string, page_number int, path_id bigint, points array<array<double>>"))


# --- texts and sizes -------------------------------------------------------------------------------

_RANGES, _RANGES_SQL = given("id int, lo string, hi string", [(1, "1", "1/2"), (2, "1/2", "2"), (3, "8", "24"), (4, "6", "6"), (5, None, "4"), (6, "x", "3"), (7, None, None), (8, "2", "1.1/2")])


@query(f"""WITH r AS (SELECT *, coalesce({X.nps('lo')} > {X.nps('hi')}, false) AS bad FROM {_RANGES_SQL}), m AS (SELECT id, bad, CASE WHEN bad THEN {trim('lo')} || ' ' || {trim('hi')} ELSE lo END AS lo, CASE WHEN bad THEN {trim('lo')} || ' ' || {trim('hi')} ELSE hi END AS hi FROM r)
SELECT id, bad AS repaired, {X.nps('lo')} AS low, {X.nps('hi')} AS high, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN CASE WHEN lo = hi THEN lo ELSE lo || '–' || hi END ELSE coalesce(lo, hi, '-') END AS label FROM m""")
def fx_ranges(spark, d):
    """Ranges that run backwards were one mixed number; labels and bounds of all."""
    m = _RANGES(spark).select("id", S.mended_range(F.col("lo"), F.col("hi")).alias("m"))
    return m.select("id", "m.repaired", S.nps(F.col("m.size_min")).alias("low"), S.nps(F.col("m.size_max")).alias("high"), S.range_label(F.col("m.size_min"), F.col("m.size_max")).alias("label"))


_TEXTS, _TEXTS_SQL = given("id int, v string", [(1, "+102500"), (2, " EL "), (3, "3.line_on_pid"), (4, "n"), (5, "-3.5"), (6, "none"), (7, ""), (8, None), (9, "4.break.x")])


@query(f"SELECT id, TRY_CAST(regexp_replace({trim('v')}, '^\\+', '') AS DOUBLE) AS elevation, CASE WHEN lower({trim('v')}) IN ('e', 'n', 'el') THEN lower({trim('v')}) END AS axis, regexp_extract(v, '^([^.]*)', 1) AS stage, regexp_extract(v, '^[^.]*\\.(.*)$', 1) AS field, coalesce(nullif(concat_ws(', ', nullif({trim('v')}, ''), CASE WHEN id % 2 = 0 THEN 'x' END), ''), '-') AS text FROM {_TEXTS_SQL}")
def fx_texts(spark, d):
    v = F.col("v")
    return _TEXTS(spark).select("id", T.elevation(v).alias("elevation"), T.axis(v).alias("axis"), T.stage_and_field(v)["stage"].alias("stage"), T.stage_and_field(v)["field"].alias("field"), T.joined_text(v, F.when(F.col("id") % 2 == 0, "x")).alias("text"))


_DETAILS, _DETAILS_SQL = given("id int, v string, want string", [
    (1, "A105N Body, SS316L Trim, Bolted Bonnet, OS&Y", "A105N Body, OS&Y"), (2, "A216 WCB, 13CR, Stellite 6, HF, RPTFE seat", "A216 WCB"), (3, "Gate, Solid Wedge", "Gate, Solid Wedge"), (4, "Welded Cover", ""), (5, "hard-faced disc, API 600", "disc, API 600"),
])


@query(f"SELECT id, want AS text FROM {_DETAILS_SQL}")
def fx_without_details(spark, d):
    """Trim and bonnet details taken out of texts, against the texts as they must read."""
    return _DETAILS(spark).select("id", crosscheck.without_details(F.col("v")).alias("text"))


_SPECS, _SPECS_SQL = given("id int, text string, a string, ra int, b string, rb int", [(1, "FLANGE WN 300# RF", "AC03N", 150, "BC70N", 300), (2, "GASKET 150#", "AC03N", 150, "BC70N", 150), (3, "ORIFICE FLANGE 300#", "AC03N", 150, "BC70N", 300), (4, "ELBOW", "AC03N", 150, "BC70N", 300)])


@query(f"SELECT id, CASE WHEN NOT contains(lower(text), 'orifice') AND (ra = r) <> (rb = r) THEN CASE WHEN ra = r THEN a ELSE b END END AS spec_class FROM (SELECT *, {X.rating('text')} AS r FROM {_SPECS_SQL})")
def fx_class_by_rating(spark, d):
    spec = lambda c, r: F.struct(F.col(c).alias("spec_class"), F.col(r).alias("rating"))
    return _SPECS(spark).select("id", T.class_by_rating(F.col("text"), F.array(spec("a", "ra"), spec("b", "rb"))).alias("spec_class"))


_ENDS, _ENDS_SQL = given("id int, value string, ends array<string>", [(1, "V-101", ["V101A", "P22"]), (2, "TANK 7", ["V101A"]), (3, "NA", ["V101A"]), (4, "CONT ON DWG 12", ["X"]), (5, "P-22 A", ["P22"]), (6, None, []), (7, "see CONT'D", ["Y"])])


@query(f"""SELECT id, {X.blank('value')} OR n = '' OR len(list_filter(ends, lambda e: e <> '' AND (contains(e, n) OR contains(n, e)))) > 0 AS met, NOT {X.blank('value')} AND regexp_matches(value, {q(gates.CONTINUED)}) AS continued
FROM (SELECT *, regexp_replace({key("coalesce(value, '')")}, '[-\\s]', '', 'g') AS n FROM {_ENDS_SQL})""")
def fx_endpoints(spark, d):
    """Route ends that correspond to one of a diagram's, and those that refer to another drawing."""
    return _ENDS(spark).select("id", gates.at_endpoint(F.col("value"), F.col("ends")).alias("met"), gates.continuation(F.col("value")).alias("continued"))


_LINES, _LINES_SQL = given("id int, candidate string, number string, classes array<string>", [(1, "100-HV-AC03N-7", "100-hv-ac03n-7 ", []), (2, "100-HV-BC70N-7", "100-HV-AC03N-7", ["AC03N", "BC70N"]), (3, "100-HV-BC70N-7", "100-HV-AC03N-7", ["AC03N"]), (4, None, "x", ["A", "B"]), (5, "100-HV-BC70N-8", "100-HV-AC03N-7", ["AC03N", "BC70N"]), (6, " ", "", [])])
_NOCLS = lambda v: f"regexp_replace(list_reduce(list_prepend({key(v)}, classes), lambda a, c: replace(a, upper(c), '')), '--+', '-', 'g')"


@query(f"SELECT id, coalesce({trim('candidate')} <> '' AND ({key('candidate')} = {key('number')} OR (len(classes) > 1 AND {_NOCLS('candidate')} = {_NOCLS('number')})), false) AS same FROM {_LINES_SQL}")
def fx_lines_across_breaks(spark, d):
    """Line numbers that are one line, in another class where the line has several."""
    return _LINES(spark).select("id", F.coalesce(gates.same_line(F.col("candidate"), F.col("number"), F.col("classes")), F.lit(False)).alias("same"))


_REFS, _REFS_SQL = given("id int, expected string, found array<string>", [(1, "pid-007", ["PID-007 SHEET 2"]), (2, "PID-007 SHEET 2", ["PID-007"]), (3, "PID-9", ["PID-007", ""]), (4, "PID-9", [])])


@query(f"SELECT id, len(list_filter(found, lambda r: r <> '' AND (contains(r, {key('expected')}) OR contains({key('expected')}, r)))) > 0 AS covered FROM {_REFS_SQL}")
def fx_coverage(spark, d):
    """Expected drawings that any found reference holds or is held by."""
    return _REFS(spark).select("id", gates.covered(F.col("expected"), F.col("found")).alias("covered"))


_IMPLIED, _IMPLIED_SQL = given("id int, implied string, bill string, valves int", [(1, "Thermowell and isolation valve", "TW FLANGED", 0), (2, "orifice plate, diaphragm seal", "ORIFICE FLANGE", 1), (3, "gauge", None, 0), (4, "thermo well", "elbow", 2)])


@query(f"SELECT id, concat_ws('; ', {', '.join(f'''CASE WHEN regexp_matches(i, {q(need)}) AND NOT regexp_matches(b, {q(have)}) THEN {q(label)} END''' for label, need, have in gates.IMPLIED)}, CASE WHEN contains(i, 'isolation valve') AND valves = 0 THEN 'isolation valve(s)' END) AS missing FROM (SELECT *, lower(implied) AS i, lower(coalesce(bill, '')) AS b FROM {_IMPLIED_SQL})")
def fx_implied_parts(spark, d):
    """Parts that a legend's typical implies and the bill lacks."""
    return _IMPLIED(spark).select("id", F.array_join(gates.implied_missing(F.col("implied"), F.col("bill"), F.col("valves")), "; ").alias("missing"))


_JOINTS, _JOINTS_SQL = given("id int, a string, b string, want boolean, tag string, met boolean", [
    (1, "SW01 at elbow", "from sw 01", True, "SW01", True), (2, "E 512000 N300", "E512000", False, "FW1", False), (3, "E5120001", "at E5120001", True, "FW1", True), (4, "FW02", "FW03", False, "FW03", True), (5, None, "SW1", False, "SW1", True), (6, "EL +102500", "EL 102500", False, "X", False), (7, "EL +102500", "el+102500", True, "X", True),
])


@query(f"SELECT id, want AS shared, met FROM {_JOINTS_SQL}")
def fx_joints(spark, d):
    """Ends that name one joint, and welds that an end names, against the answers as they must be."""
    return _JOINTS(spark).select("id", spools.shares_joint(F.col("a"), F.col("b")).alias("shared"), spools.meets_weld(F.col("tag"), F.col("a"), F.col("b")).alias("met"))


_KINDS, _KINDS_SQL = given("id int, one string, other string, manual string, type string", [(1, "item 13 valve", "SW01", None, "FIELD WELD"), (2, "gate valve", "elbow", None, "shop"), (3, "gasket", "tie-in", "fitting", ""), (4, "tee", None, None, None), (5, "nothing", "valve item 7", None, "in field")])
_END = lambda c: f"CASE WHEN regexp_matches(lower({c}), '\\b(?:bw|sw|fw)\\s*0*\\d+\\b') THEN 'weld' WHEN regexp_matches(lower({c}), '\\bvalves?\\b') OR regexp_extract(lower({c}), '\\bitem\\s*(\\d+)\\b', 1) IN ('7', '13', '14', '19') THEN 'valve' {' '.join(f'WHEN regexp_matches(lower({c}), {q(p)}) THEN {q(n)}' for n, p in K.ENDS)} END"


@query(f"""WITH e AS (SELECT *, {_END('one')} AS a0, {_END('other')} AS b0 FROM {_KINDS_SQL}), k AS (SELECT *, CASE WHEN a0 = 'valve' AND b0 = 'weld' THEN NULL ELSE a0 END AS a, CASE WHEN b0 = 'valve' AND a0 = 'weld' THEN NULL ELSE b0 END AS b FROM e)
SELECT id, a, b, coalesce(manual, CASE WHEN a = 'valve' OR b = 'valve' THEN 'valve' END, a, b) AS kind, CASE WHEN trim(type) <> '' THEN contains(lower(type), 'field') END AS field FROM k""")
def fx_dimension_kinds(spark, d):
    """Kinds of a dimension's ends, a valve opposite a weld being none of its own, and of the whole."""
    a0, b0 = K.dimension_end(F.col("one")), K.dimension_end(F.col("other"))
    e = _KINDS(spark).select("id", "manual", "type", K.without_cross_end(a0, b0).alias("a"), K.without_cross_end(b0, a0).alias("b"))
    return e.select("id", "a", "b", spools.dimension_kind(F.col("a"), F.col("b"), F.col("manual")).alias("kind"), K.implies_field(F.col("type")).alias("field"))


# --- chains, clusters ------------------------------------------------------------------------------

_DIMS, _ = given("g string, dim_id bigint, from_ref string, to_ref string, value double", [("s", 1, "SW1", "E1000001", 100.0), ("s", 2, "E1000001", "SW2", 50.0), ("s", 3, "SW2", "SW3", 25.0), ("s", 4, "SW1", "SW9", 10.0), ("s", 5, "E1000001", "FW7", 70.0), ("s", 6, None, "loose end", 5.0)])
_PIECES, _ = given("g string, piece_id bigint, from_ref string, to_ref string", [("s", 1, "SW1", "SW3"), ("s", 2, "SW9", "SW1"), ("s", 3, "SW3", "FW7"), ("s", 4, "SW1", "nowhere")])


@query("SELECT * FROM (VALUES ('s', CAST(1 AS BIGINT), '1,2,3', CAST(175 AS DOUBLE)), ('s', 2, '4', 10), ('s', 3, '3,2,5', 145)) t(g, piece_id, chain, total)")
def fx_chains(spark, d):
    """The shortest chain of dimensions between the ends of each cut piece, against the chains as they must be."""
    return spools.chains(_PIECES(spark), _DIMS(spark), ["g"]).select("g", "piece_id", F.array_join(F.col("chain").cast("array<string>"), ",").alias("chain"), "total")


@query("SELECT 's' AS g, CAST(105 AS DOUBLE) AS total")
def fx_clusters(spark, d):
    """Dimensions that share a landmark count once, with the largest; the one without landmarks stands alone."""
    return spools.clustered_sum(_DIMS(spark), ["g"], "dim_id", "value", ["from_ref", "to_ref"])


# --- sinks and jobs --------------------------------------------------------------------------------

_OLD, _OLD_SQL = given("id int, project_id string, file_hash string, flag string", [(1, "p", "h1", None), (2, "p", "h2", "a"), (3, None, "h3", "b")])
_NEW, _NEW_SQL = given("id int, project_id string, file_hash string, flag string", [(1, "p", "h1", "x"), (2, "p", "h2", "a"), (4, "p", "h9", None), (5, "p", "h9", None), (3, None, "h3", None)])


@query(f"SELECT min(n.id) AS id, n.project_id, n.file_hash FROM {_NEW_SQL} n WHERE NOT EXISTS (SELECT 1 FROM {_OLD_SQL} o WHERE o.project_id IS NOT DISTINCT FROM n.project_id AND o.file_hash IS NOT DISTINCT FROM n.file_hash) GROUP BY ALL")
def fx_new_rows(spark, d):
    """Rows to insert: one per key, keys that exist left out."""
    return sinks.new_rows(_NEW(spark), _OLD(spark), ["project_id", "file_hash"]).select("id", "project_id", "file_hash")


@query(f"SELECT n.id, n.flag FROM {_NEW_SQL} n LEFT JOIN {_OLD_SQL} o USING (id) WHERE o.id IS NULL OR n.flag IS DISTINCT FROM o.flag")
def fx_changed_rows(spark, d):
    """Rows whose flag differs from the stored one."""
    return sinks.changed(_OLD(spark), _NEW(spark), "id", ["flag"]).select("id", "flag")


_FINDINGS, _FINDINGS_SQL = given("id int, doc_a_id string, doc_b_id string", [(1, "a", "b"), (2, "b", None), (3, "c", "a"), (4, "c", None), (5, None, None)])


@query(f"SELECT id FROM {_FINDINGS_SQL} WHERE NOT coalesce(doc_a_id = 'a' OR doc_b_id = 'a', false) AND coalesce(doc_a_id, '') <> 'a' AND coalesce(doc_b_id, '') <> 'a'")
def fx_without_document(spark, d):
    """Findings left when a document goes: those that cite it on neither side."""
    return sinks.without_document({"findings": _FINDINGS(spark)}, "a")["findings"].select("id")


_JOBS, _JOBS_SQL = given("id int, status string, started_at timestamp, error_message string", [(1, "running", "2024-05-01 10:00:00", None), (2, "running", "2024-05-01 11:50:00", None), (3, "queued", "2024-05-01 09:00:00", None), (4, "running", None, None), (5, "failed", "2024-05-01 09:00:00", "x")])


@query(f"SELECT id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-05-01 12:00:00' - INTERVAL 15 MINUTE THEN 'failed' ELSE status END AS status FROM {_JOBS_SQL}")
def fx_stale_jobs(spark, d):
    """Running jobs that started before the cut-off have failed."""
    return jobs.fail_stale(_JOBS(spark), F.lit("2024-05-01 12:00:00").cast("timestamp")).select("id", "status")


# --- tables ----------------------------------------------------------------------------------------


@query("SELECT id, CASE WHEN lower(file_name) LIKE '%.xlsx' THEN 'xlsx' WHEN lower(file_name) LIKE '%.csv' THEN 'csv' ELSE 'pdf' END AS kind FROM project_documents")
def src_page_kinds(spark, d):
    """The reader of every document by its file name."""
    return table(spark, d, "project_documents").select("id", pages.page_kind(F.col("file_name")).alias("kind"))


_WELDS, _WELDS_SQL = given("g string, weld_id bigint, size string, note string", [
    ("a", 1, "4\"", "at item 07 weldolet"), ("a", 2, "4\"", "item 7 (tee)"), ("a", 3, "4\"", "item 8 tee"), ("b", 4, "2\"", "item 3 tee"), ("b", 5, "4\"", "item 3 tee"), ("c", 6, None, "item 1 weldolet"), ("c", 7, "6\"", "item 01 weldolet"), ("c", 8, "6\"", None),
])


@query(f"""WITH w AS (SELECT *, regexp_replace(regexp_extract(note, {q(spools.REDUCING_ITEM)}, 1), '^0+(\\d)', '\\1') AS item FROM {_WELDS_SQL}),
g AS (SELECT g, item FROM w WHERE item <> '' GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT CASE WHEN NOT {X.blank('size')} THEN size END) = 1) SELECT w.weld_id, w.item AS item_no FROM w JOIN g USING (g, item)""")
def fx_same_size(spark, d):
    """Welds of a reducing item that all state one size."""
    return spools.same_size_items(_WELDS(spark), ["g"]).select("weld_id", "item_no")


_FILES, _FILES_SQL = given("id int, project_id string, doc_type string, page_count int, file_name string, storage_path string", [
    (1, "p", "iso", 3, "a.PDF", "p/x-a.pdf"), (2, "p", "letter", 3, "a.pdf", "p/x"), (3, "p", "pll", 0, "b.xlsx", "q/b.xlsx"), (4, "p", None, 1, "c.csv", None), (5, "p", "ga", 1, "d.docx", "p"), (6, None, "pid", None, "e.pdf", "p/e.pdf"),
])


@query(f"SELECT id, doc_type FROM {_FILES_SQL} WHERE doc_type IS NULL OR doc_type NOT IN ({', '.join(map(q, service.DOC_TYPES))}) OR page_count < 1 OR NOT regexp_matches(lower(file_name), '\\.(pdf|csv|xlsx)$')")
def fx_bad_documents(spark, d):
    """Documents of an unknown type, without pages or of a file kind without a reader."""
    return _FILES(spark).filter(service.bad_document()).select("id", "doc_type")


@query(f"SELECT id FROM {_FILES_SQL} WHERE string_split(storage_path, '/')[1] IS DISTINCT FROM project_id")
def fx_foreign_paths(spark, d):
    """Files stored outside their project's folder."""
    return _FILES(spark).filter(service.foreign_path()).select("id")


@query(f"""WITH b AS (SELECT id, spec_class, CASE WHEN json_valid(attributes) AND json_type(CAST(attributes AS JSON) -> '$.spec_breaks') = 'ARRAY' THEN list_transform(CAST(CAST(attributes AS JSON) -> '$.spec_breaks' AS JSON[]), lambda x: x ->> '$.spec_class') ELSE [] END AS br FROM (SELECT id, attributes, json_extract_string(attributes, '$.spec_class') AS spec_class FROM extracted_tags WHERE tag_type = 'line' AND doc_type = 'iso')),
c AS (SELECT id, list_filter(list_prepend(spec_class, br), lambda x: NOT {X.blank('x')}) AS cs FROM b), e AS (SELECT id, {key('c')} AS c, pos FROM (SELECT id, unnest(cs) AS c, unnest(range(len(cs))) AS pos FROM c)),
f AS (SELECT id, c, min(pos) AS pos FROM e GROUP BY ALL) SELECT id, string_agg(c, ',' ORDER BY pos) AS classes FROM f GROUP BY id""")
def agg_drawing_classes(spark, d):
    """Distinct classes of every drawing in the order they are first seen; drawings without any are left out."""
    lines = gates.iso_lines(table(spark, d, "extracted_tags"))
    own = tags(spark, d, "line", "iso", ["spec_class"]).select(F.col("id").alias("tag_id"), F.col("spec_class").alias("own"))
    c = lines.select("tag_id", "breaks").join(own, "tag_id").select(F.col("tag_id").alias("id"), gates.drawing_classes(F.col("own"), F.col("breaks")).alias("c"))
    return c.filter(F.size("c") > 0).select("id", F.array_join("c", ",").alias("classes"))


@query("SELECT project_id, doc_type, arg_max(id, (uploaded_at, id)) AS id, count(*) AS documents FROM project_documents WHERE uploaded_at IS NOT NULL GROUP BY ALL")
def top_newest_documents(spark, d):
    """The newest document of each type in each project."""
    p = table(spark, d, "project_documents").filter("uploaded_at is not null")
    return p.groupBy("project_id", "doc_type").agg(F.max_by("id", F.struct("uploaded_at", "id")).alias("id"), F.count("*").alias("documents"))


@query("SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY doc_type, uploaded_at DESC NULLS LAST, id) AS place FROM project_documents")
def win_document_order(spark, d):
    """Documents of a project as they are listed: by type, the newest first."""
    w = Window.partitionBy("project_id").orderBy("doc_type", F.col("uploaded_at").desc_nulls_last(), "id")
    return table(spark, d, "project_documents").select("id", F.row_number().over(w).alias("place"))


# --- tenancy: projects of the tables in sixteen organisations, one user in half of them --------------

_MEMBERS, _MEMBERS_SQL = given("organization_id string, user_id string", [(f"org-{c}", "u1") for c in "01234567"] + [("org-0", "u1"), ("org-8", "u2"), (None, "u1")])
_PROJECTS_SQL = "(SELECT DISTINCT project_id AS id, 'org-' || substr(md5(project_id), 1, 1) AS organization_id FROM project_documents WHERE project_id IS NOT NULL)"
_MINE = f"(SELECT p.id FROM {_PROJECTS_SQL} p WHERE EXISTS (SELECT 1 FROM {_MEMBERS_SQL} m WHERE m.organization_id = p.organization_id AND m.user_id = 'u1'))"


def _projects(spark, d) -> DataFrame:
    p = table(spark, d, "project_documents").filter("project_id is not null").select(F.col("project_id").alias("id")).distinct()
    return p.withColumn("organization_id", F.concat(F.lit("org-"), F.substring(F.md5("id"), 1, 1)))


@query(f"SELECT id FROM extracted_tags WHERE project_id IN {_MINE}")
def ten_visible_tags(spark, d):
    """Tags that a user sees: those of projects of their organisations."""
    return tenancy.visible(table(spark, d, "extracted_tags").select("id", "project_id"), _projects(spark, d), _MEMBERS(spark), "u1").select("id")


@query(f"SELECT id FROM document_pages WHERE document_id IN (SELECT id FROM project_documents WHERE project_id IN {_MINE})")
def ten_visible_pages(spark, d):
    """Pages that a user sees, through their documents' projects; pages of documents that are gone are seen by nobody."""
    return tenancy.visible(table(spark, d, "document_pages").select("id", "document_id"), _projects(spark, d), _MEMBERS(spark), "u1", table(spark, d, "project_documents").select("id", "project_id")).select("id")


_SETS, _SETS_SQL = given("id int, organization_id string", [(1, None), (2, "org-0"), (3, "org-8"), (4, "org-7"), (5, "org-f")])


@query(f"SELECT id FROM {_SETS_SQL} s WHERE organization_id IS NULL OR EXISTS (SELECT 1 FROM {_MEMBERS_SQL} m WHERE m.organization_id = s.organization_id AND m.user_id = 'u1')")
def ten_rule_sets(spark, d):
    """Rule sets of everybody and those of the user's organisations."""
    return tenancy.global_or_mine(_SETS(spark), _MEMBERS(spark), "u1").select("id")


_ORGS, _ORGS_SQL = given("id string, name string", [(f"org-{c}", f"Office {c}") for c in "0123456789abcdef"])


@query(f"SELECT o.id AS organization_id, name, coalesce((SELECT string_agg(p.id, ',' ORDER BY p.id) FROM {_PROJECTS_SQL} p WHERE p.organization_id = o.id), '') AS projects FROM {_ORGS_SQL} o WHERE EXISTS (SELECT 1 FROM {_MEMBERS_SQL} m WHERE m.organization_id = o.id AND m.user_id = 'u1')")
def ten_projects(spark, d):
    """A user's organisations with their projects."""
    return tenancy.by_organisation(_projects(spark, d), _MEMBERS(spark), _ORGS(spark), "u1").select("organization_id", "name", F.array_join("projects", ",").alias("projects"))
