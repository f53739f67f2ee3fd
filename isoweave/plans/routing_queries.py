"""Routing and fittings, legends and lookups by code, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import gates as G
from ..operators import relational as R
from ..operators import routing as O
from ..runtime import table
from ..sources import pages
from . import scalar_queries as X
from .chain_queries import ORACLE as CHAIN
from .fixture_queries import given
from .relational_queries import _FIRST
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


_SLOPE = lambda v: f"CASE WHEN {trim(v)} = '' THEN NULL WHEN regexp_matches({trim(v)}, {q(T.SLOPE)}) THEN regexp_extract({trim(v)}, {q(T.SLOPE)}, 1) || ':' || regexp_extract({trim(v)}, {q(T.SLOPE)}, 2) ELSE {trim(v)} END"
_WHOLE = lambda n: f"CASE WHEN {n} = floor({n}) THEN CAST(CAST({n} AS BIGINT) AS VARCHAR) ELSE CAST(round({n}, 6) AS VARCHAR) END"
_DRAWN = " UNION ALL ".join(f"SELECT project_id, document_id, k, {q(c.capitalize())} AS field, {_WHOLE('n')} AS iso_value, NULL AS pid_value, 'iso only' AS status FROM l JOIN t USING (document_id, k) WHERE fitting = {q(c)} AND n > 0" for c in O.DRAWN)


@query(f"""WITH l AS (SELECT project_id, document_id, {key('tag_number')} AS k, {', '.join(f"{_FIRST(f, 'arg_max' if f == 'to_location' else 'arg_min')} AS {f}" for f in ('from_location', 'to_location', 'slope'))} FROM {bag('b', ['from_location', 'to_location', 'slope'], "tag_type = 'line' AND doc_type = 'iso'")} GROUP BY ALL),
b AS (SELECT document_id, {key('line_number')} AS k, {X.FITTING_SQL} AS fitting, coalesce({X.num('quantity')}, 1) AS qt FROM {bag('b', ['line_number', 'component_type', 'description', 'quantity'], "tag_type = 'bom_item'")}),
t AS (SELECT document_id, k, fitting, sum(qt) AS n FROM b WHERE fitting IS NOT NULL GROUP BY ALL),
v AS (SELECT project_id, {key('line_number')} AS k, sum(coalesce({X.num('quantity')}, 1)) AS n FROM {bag('b', ['line_number', 'quantity'], "tag_type = 'valve' AND doc_type = 'pid'")} GROUP BY ALL)
SELECT project_id, document_id, k, 'Route from' AS field, CASE WHEN NOT {blank('from_location')} THEN from_location END AS iso_value, NULL AS pid_value, 'not compared' AS status FROM l
UNION ALL SELECT project_id, document_id, k, 'Route to', CASE WHEN NOT {blank('to_location')} THEN to_location END, NULL, 'not compared' FROM l
UNION ALL SELECT project_id, document_id, k, 'Slope', CASE WHEN NOT {blank('slope')} THEN {_SLOPE('slope')} END, NULL, 'not compared' FROM l
UNION ALL SELECT l.project_id, l.document_id, l.k, 'Valves', {_WHOLE('coalesce(t.n, 0)')}, NULL, CASE WHEN coalesce(v.n, 0) = 0 THEN 'not compared' WHEN coalesce(t.n, 0) >= v.n THEN 'match' ELSE 'mismatch' END FROM l LEFT JOIN t ON t.document_id = l.document_id AND t.k = l.k AND t.fitting = 'valves' LEFT JOIN v ON v.project_id = l.project_id AND v.k = l.k
UNION ALL {_DRAWN}""")
def check_routing(spark, d):
    """Ends, slope, valves and drawn fittings of every line beside the diagrams of its project; these list no lines and no fittings."""
    k = lambda c: T.tag_key(F.col(c)).alias("k")
    iso = tags(spark, d, "line", "iso", ["from_location", "to_location", "slope"]).withColumn("k", T.tag_key(F.col("tag_number"))).withColumn("page", F.coalesce("source_page", F.lit(0)))
    lines = R.merge_lines(iso, ["project_id", "document_id", "k"], ["from_location", "to_location", "slope"], ["page", "id"], last=("to_location",)).drop("sheets")
    bom = tags(spark, d, "bom_item", fields=["line_number", "component_type", "description", "quantity"]).select("document_id", k("line_number"), "component_type", "description", "quantity")
    pid = tags(spark, d, "line", "pid", ["from_equipment", "to_equipment", "slope"]).select("project_id", k("tag_number"), "id", "from_equipment", "to_equipment", "slope")
    valves = tags(spark, d, "valve", "pid", ["line_number", "quantity"]).select("project_id", k("line_number"), "quantity")
    fittings = tags(spark, d, "fitting", "pid", ["line_number", "fitting_type", "size", "quantity"]).select("project_id", k("line_number"), "fitting_type", "size", "quantity")
    return O.routing(lines, bom, pid, valves, fittings)


_L = given("project_id string, document_id string, k string, from_location string, to_location string, slope string", [("p", "d", "L1", "V-101", "cont on dwg 7", "1 in 100"), ("p", "d", "L2", "T-9", None, None)])[0]
_B = given("document_id string, k string, component_type string, description string, quantity string", [("d", "L1", "FITTING", "REDUCER CONC", "1"), ("d", "L1", "VALVE", "GATE VALVE", None), ("d", "L2", "CAP", "CAP", "2")])[0]
_P = given("project_id string, k string, id int, from_equipment string, to_equipment string, slope string", [("p", "L1", 2, "P-7", "T-1", "1:200"), ("p", "L1", 1, "V101", None, "1/100"), ("p", "L2", 3, "T-8", "NA", None)])[0]
_V = given("project_id string, k string, quantity string", [("p", "L1", "2"), ("p", "L2", None)])[0]
_F = given("project_id string, k string, fitting_type string, size string, quantity string", [("p", "L1", "Reducer", "4\"", "2"), ("p", "L2", "cap", None, None)])[0]


@query("""SELECT 'p' AS project_id, 'd' AS document_id, * FROM (VALUES ('L1', 'Route from', 'V-101', 'V101 / P-7', 'match'), ('L1', 'Route to', 'cont on dwg 7', 'T-1', 'not compared'), ('L1', 'Slope', '1:100', '1:100 / 1:200', 'match'), ('L1', 'Valves', '1', '2', 'mismatch'), ('L1', 'Reducers', '1', '2 drawn (min)', 'mismatch'),
('L2', 'Route from', 'T-9', 'T-8', 'mismatch'), ('L2', 'Route to', NULL, NULL, 'not compared'), ('L2', 'Slope', NULL, NULL, 'not compared'), ('L2', 'Valves', '0', '1', 'mismatch'), ('L2', 'Caps', '2', '1 drawn (min)', 'match')) t(k, field, iso_value, pid_value, status)""")
def fx_routing(spark, d):
    """Routing rows of two lines, against the rows as they must be."""
    return O.routing(_L(spark), _B(spark), _P(spark), _V(spark), _F(spark))


_LEGEND, _LEGEND_SQL = given("id int, project_id string, document_id string, symbol string, meaning string, category string, symbol_shape string, applies_to string, implied_components string", [
    (2, "p", "new", "TI", "temperature", "instrument", "", "TI / TE", "thermowell"), (1, "p", "new", "GV", "gate valve", None, "bowtie", None, None), (3, "p", "new", "PI", None, "instrument", None, "PI/PG", "isolation valve"), (4, "p", "old", "XX", "old", "old", None, "TI", "orifice"), (5, "p", "new", "T2", "x", "", None, "TI", " "),
])
_DOCS, _DOCS_SQL = given("id string, uploaded_at timestamp", [("new", "2024-02-01 00:00:00"), ("old", "2024-01-01 00:00:00")])
_NEWEST = f"(SELECT * FROM {_LEGEND_SQL} WHERE document_id = (SELECT arg_max(id, uploaded_at) FROM {_DOCS_SQL}))"


@query(f"""SELECT coalesce(nullif(category, ''), 'general') AS category, string_agg(symbol || ' = ' || coalesce(meaning, '') || CASE WHEN symbol_shape <> '' THEN ' [drawn as: ' || symbol_shape || ']' ELSE '' END || CASE WHEN implied_components <> '' THEN ' [applies to: ' || coalesce(applies_to, '?') || '; implies on ISO: ' || implied_components || ']' ELSE '' END, chr(10) ORDER BY id) AS lines FROM {_NEWEST} GROUP BY 1""")
def fx_legend(spark, d):
    """What the newest legend defines, by category."""
    return O.legend_lines(O.newest_legend(_LEGEND(spark), _DOCS(spark)))


_INST, _INST_SQL = given("id int, tag_number string", [(1, "ti-100"), (2, " PG 7"), (3, "FT-1"), (4, "100"), (5, None), (6, "TE9")])


@query(f"""WITH t AS (SELECT id, {trim('a')} AS letters FROM (SELECT id, unnest(string_split(upper(applies_to), '/')) AS a FROM {_NEWEST} WHERE {trim('implied_components')} <> ''))
SELECT i.id, min(t.id) AS typical_id FROM {_INST_SQL} i JOIN t ON t.letters = regexp_extract({key('i.tag_number')}, '^([A-Z]+)', 1) AND t.letters <> '' GROUP BY i.id""")
def fx_typicals(spark, d):
    """Instruments with the legend item that applies to their letters."""
    return O.typicals(_INST(spark), O.newest_legend(_LEGEND(spark), _DOCS(spark)))


_NAMED, _NAMED_SQL = given("id int, v string, texts array<string>", [(1, "PS01 guide", ["support ps01 type", "x"]), (2, "PS02 and G15", ["g15"]), (3, "PS03", ["PS04"]), (4, "shoe", ["shoe"]), (5, "TI-1", ["ti-100 gauge"]), (6, "TI-1", [])])
_TYPES = f"regexp_extract_all(v, {q(G.SUPPORT_TYPE)})"
_HOLDS = lambda t: f"len(list_filter(texts, lambda x: contains(upper(x), upper({t})))) > 0"


@query(f"SELECT id, CASE WHEN len({_TYPES}) > 0 THEN len(list_filter({_TYPES}, lambda s: {_HOLDS('s')})) > 0 END AS supports, {_HOLDS('v')} AS named FROM {_NAMED_SQL}")
def fx_named_in_texts(spark, d):
    """Support types and instruments that stand in any of the texts."""
    return _NAMED(spark).select("id", O.supports_listed(F.col("v"), F.col("texts")).alias("supports"), O.named_in(F.col("v"), F.col("texts")).alias("named"))


_CODES, _CODES_SQL = given("id int, code string, a string, b string, c string", [(1, "x1 ", "X1", None, "X1"), (2, "V7", None, "v7", "V7"), (3, "Q", "Q1", "Q2", "Q3"), (4, "", "", None, None), (5, None, "X1", None, None)])


@query(f"SELECT id, CASE WHEN code <> '' THEN CASE {key('code')} WHEN {key('coalesce(a, b)')} THEN 'first' WHEN {key('c')} THEN 'second' END END AS material FROM {_CODES_SQL}")
def fx_rows_by_code(spark, d):
    """The first row of an item code, by item code or valve index code."""
    row = lambda a, b, m: F.struct(a.cast("string").alias("item_code"), b.cast("string").alias("valve_index_code"), F.lit(m).alias("material"))
    rows = F.array(row(F.col("a"), F.col("b"), "first"), row(F.lit(None), F.col("c"), "second"))
    return _CODES(spark).select("id", O.row_by_code(rows, F.col("code"))["material"].alias("material"))


_SHEETS, _ = given("id bigint, page_text string", [
    (1, "[Worksheet: OLETS]\nItemCode\tSizes\tCatalogPartId\tMaterial\tShortDescription\tNominalDiameter\tRemark\nA1\t4x2\tC9\tA105\tWELDOLET\t\tnew \n\t\t\t\t\t\t\n\t6\tC8\t\t\t150\t"), (2, "SPREF\tSPEC OF SPCO\tGTYPE OF CATREF\tCatalogue\tDetailing text\tMaterial text\tSize P1\tSize P2\tBy\n/A/1\tA\tTEE\tC\tTEE EQ\tA234\t100\t50\tme\n/A/2\tA\t\tC\tx\ty\t1\t2\tz"),
    (3, "ItemCode\tMaterial\nB1\tX"), (4, "ONE\tTWO\n1\t2"), (5, "no grid"), (6, None),
])


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, 'A1', 'OLETS', '4x2', 'Remark=new'), (1, 2, '6', 'OLETS', '150', ''), (2, 0, '/A/1', 'TEE', '100', 'By=me'), (3, 0, 'B1', 'UNKNOWN', '', '')) t(id, row_no, reference, type, size_p1, extra)")
def fx_sheet_shapes(spark, d):
    """Item lists and catalogues of pages with their other cells, against the rows as they must be."""
    r = pages.sheet_rows(_SHEETS(spark))
    return r.select("id", "row_no", "reference", "type", "size_p1", F.array_join(F.transform("extra", lambda s: F.concat(s["key"], F.lit("="), s["value"])), "; ").alias("extra"))


@query(f"""SELECT id, count(*) OVER (PARTITION BY document_id, k, governing) AS items, row_number() OVER (PARTITION BY document_id, k, governing ORDER BY num NULLS LAST, id) AS place FROM (SELECT id, document_id, {key('line_number')} AS k, coalesce({trim('item_spec_class')}, '') AS governing, TRY_CAST(regexp_extract(tag_number, '(\\d+)\\s*$', 1) AS BIGINT) AS num FROM {bag('b', ['line_number', 'item_spec_class'], "tag_type = 'bom_item'")})""")
def win_bom_by_class(spark, d):
    """Bill items of a line under their class, in the order of their numbers."""
    b = tags(spark, d, "bom_item", fields=["line_number", "item_spec_class"]).select("id", "document_id", T.tag_key(F.col("line_number")).alias("k"), T.trimmed(F.coalesce("item_spec_class", F.lit(""))).alias("g"), F.regexp_extract("tag_number", r"(\d+)\s*$", 1).try_cast("bigint").alias("num"))
    w = Window.partitionBy("document_id", "k", "g")
    return b.select("id", F.count("*").over(w).alias("items"), F.row_number().over(w.orderBy(F.col("num").asc_nulls_last(), "id")).alias("place"))


@query(f"SELECT *, row_number() OVER (ORDER BY field_checked, severity) AS place FROM (SELECT field_checked, severity, count(*) AS n, count(DISTINCT document_id) AS documents FROM ({CHAIN['check_findings']}) GROUP BY field_checked, severity)")
def agg_findings(spark, d):
    """Findings counted by code in the order of their codes as texts."""
    f = G.findings(table(spark, d, "extracted_tags")).groupBy("field_checked", "severity").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))
    # One row per code: a few dozen.
    return f.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("field_checked", "severity")))
