"""Queries p1, p2 and p7 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.quantity import KNOWN_UNITS, quantity_of, remark_unit
from ..operators import references, shred, units
from ..runtime import materialise, table

SHEET_CHILDREN = ["bom_items", "welds"]
TAG_CHILDREN = ["spec_breaks", "pipes", "fittings", "flanges", "valves"]


def _sheets(spark: SparkSession, d: str) -> shred.Shredded:
    return shred.shred(table(spark, d, "extraction_results"), "raw_json", ["id"], root="sheets", only=set(SHEET_CHILDREN))


def _bags(spark: SparkSession, d: str) -> shred.Shredded:
    return shred.shred(table(spark, d, "extracted_tags"), "attributes", ["id"], only=set(TAG_CHILDREN))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    child = F.regexp_extract("level", r"(\w+)$", 1)
    parts = []
    for name, s, kept, sheet in (("extraction_results", _sheets(spark, d), F.col("level").rlike(r"^sheets/result[./]\w+$"), F.try_element_at("ords", F.lit(1))), ("extracted_tags", _bags(spark, d), F.size("ords") == 1, F.lit(0))):
        parts.append(
            s.rows.filter(shred.is_object(F.col("v")) & kept).select(
                F.lit(name).alias("parent_table"), F.col("id").cast("string").alias("parent_id"), sheet.cast("int").alias("sheet_pos"), child.alias("child"), F.try_element_at("ords", F.lit(-1)).cast("int").alias("child_pos")
            )
        )
    return parts[0].unionByName(parts[1])


def _flat(s: shred.Shredded, *levels: str) -> DataFrame:
    """Flat table of levels that the walk did not go below: what their elements hold further down stays as JSON text."""
    s.schema |= shred.infer(s.rows, "level", "v", 400)
    for node in (s.schema[x] for x in levels if x in s.schema):
        node.leaves |= {p: "VARIANT" for p in node.repeated if p != shred.LIST}
    s.whole = True
    # Keys made from places in files differ between copies of a table: the queries show natural ids and positions.
    flat = s.flat(*levels).withColumn("parent_ords", F.array_join(F.col("parent_ords").cast("array<string>"), "."))
    return flat.drop("row_key", "parent_key", "element_key").withColumnRenamed("parent_ords", "parent_pos")


def p1_welds(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of the welds of all ISO sheets, with the parent's id and position; a result stored as an array adds its own to parent_pos."""
    return _flat(_sheets(spark, d), "sheets/result.welds", "sheets/result/welds")


def p1_bom_items(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_sheets(spark, d), "sheets/result.bom_items", "sheets/result/bom_items")


LINE_FIELDS = ["design_pressure", "operating_pressure", "hydrotest_pressure", "test_pressure", "design_temperature", "operating_temperature", "insul_thickness_mm", "insulation_thickness", "corrosion_allowance"]
#: Fields that other sources name otherwise.
_SAME_FIELD = {"hydrotest_pressure": "test_pressure", "insul_thickness_mm": "insulation_thickness"}
_LINK = ["document_id", "line", "link_field"]


def _link_field(field: Column) -> Column:
    f = F.regexp_replace(F.lower(F.trim(field)), r"\s+", "_")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in _SAME_FIELD.items() for x in kv])[f], f)


def _stated(rows: DataFrame, keep: list[str], text: Callable[[str], Column]) -> DataFrame:
    """One row per quantity field that a record states, whatever its form."""
    kind = lambda f: "pressure" if "pressure" in f else "temperature" if "temperature" in f else "length"
    return rows.select(*keep, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(kind(f)).alias("quantity"), text(f).alias("text")) for f in LINE_FIELDS]))).filter("text is not null")


def _sheet_fields(spark: SparkSession, d: str) -> DataFrame:
    """Quantity fields of every sheets[].result, with result_pos 0 where it is no array."""
    v = table(spark, d, "extraction_results").select(F.col("id").alias("result_id"), "document_id", shred.parse(F.col("raw_json")).alias("v"))
    s = v.select("result_id", "document_id", F.posexplode(shred.elements(shred.at(F.col("v"), "sheets"))).alias("sheet_pos", "s"))
    r = s.select("result_id", "document_id", "sheet_pos", F.posexplode(shred.elements(shred.at(F.col("s"), "result"))).alias("result_pos", "r"))
    r = r.withColumn("line", T.tag_key(F.try_variant_get("r", "$.line_number", "string")))
    return _stated(r, ["result_id", "document_id", "sheet_pos", "result_pos", "line"], lambda f: F.try_variant_get("r", f"$.{f}", "string"))


def _line_fields(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "extracted_tags").filter("tag_type = 'line'")
    bags = t.select(F.col("id").alias("tag_id"), "project_id", "doc_type", T.tag_key(F.col("tag_number")).alias("line"), F.from_json("attributes", ", ".join(f"{f} string" for f in LINE_FIELDS)).alias("a"))
    return _stated(bags, ["tag_id", "project_id", "doc_type", "line"], lambda f: F.col(f"a.{f}"))


def _linked(spark: SparkSession, d: str, sheets: DataFrame) -> DataFrame:
    """Pairs of values of one line and field: sheets against the design basis and against line list tags.

    What a row of the design basis pairs already is left out, so no reading counts twice.
    """
    sheets = units.read(sheets, "text", "number", "unit").withColumn("link_field", _link_field(F.col("field")))
    quantity = quantity_of(F.col("field"))
    basis = table(spark, d, "design_basis").withColumn("quantity", quantity).filter("quantity is not null")
    basis = basis.select("document_id", "project_id", T.tag_key(F.col("line_number")).alias("line"), _link_field(F.col("field")).alias("link_field"), "quantity", "iso_value", "pll_value", "remarks")
    for side in ("iso", "pll"):
        basis = units.read(basis, f"{side}_value", f"{side}_number", f"{side}_unit")
        basis = basis.withColumn(f"{side}_unit", F.when(F.col(f"{side}_unit") != "", F.col(f"{side}_unit")).otherwise(remark_unit(F.col("remarks"), side.upper(), F.col("quantity"))))
    lists = units.read(_line_fields(spark, d).filter("doc_type = 'pll'"), "text", "number", "unit").withColumn("link_field", _link_field(F.col("field")))
    projects = table(spark, d, "project_documents").select(F.col("id").alias("document_id"), "project_id").unionByName(table(spark, d, "design_basis").select("document_id", "project_id"))
    projects = projects.filter("document_id is not null and project_id is not null").distinct()
    to_basis = units.link(sheets, basis.select(*_LINK, "quantity", F.col("pll_number").alias("number"), F.col("pll_unit").alias("unit")), _LINK)
    to_lists = units.link(sheets.join(projects, "document_id"), lists, ["project_id", "line", "link_field"])
    here = basis.select("project_id", "line", "link_field", "quantity", F.col("iso_unit").alias("ua"), F.col("pll_unit").alias("ub"), F.col("iso_number").alias("a"), F.col("pll_number").alias("b")).filter("a is not null and b is not null")
    cols = ["project_id", "line", "link_field", "quantity", "ua", "ub", "a", "b"]
    both = to_basis.join(projects, "document_id").select(*cols).unionByName(to_lists.select(*cols)).distinct()
    return both.join(here.distinct(), cols, "left_anti")


def _harmonised(spark: SparkSession, d: str, sheets: DataFrame | None = None) -> units.Harmonised:
    """The design basis in common units, with what all sources teach about spellings."""
    sheets = materialise(_sheet_fields(spark, d), "sheet-fields") if sheets is None else sheets
    return units.harmonise(table(spark, d, "design_basis"), linked=_linked(spark, d, sheets))


def _tag_table(child: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = shred.shred(table(spark, d, "extracted_tags"), "attributes", ["id"], only={child})
        return _flat(s, f"$/{child}")

    run.__name__, run.__doc__ = f"p1_{child}", f"Flat table of the {child} of all tags, with the tag's id and the position."
    return run


def p1_tag_elements(spark: SparkSession, d: str) -> DataFrame:
    """Every element of every level of all tags' attributes, with its parent's positions, as JSON text."""
    s = shred.shred(table(spark, d, "extracted_tags"), "attributes", ["id"])
    below = s.rows.filter(F.col("level") != "$")
    up = F.slice("ords", F.lit(1), F.greatest(F.size("ords") - 1, F.lit(0)))
    return below.select("id", "level", F.array_join(up.cast("array<string>"), ".").alias("parent_pos"), F.try_element_at("ords", F.lit(-1)).alias("pos"), F.to_json("v").alias("element"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    h = _harmonised(spark, d)
    return h.rows.filter(units.differ(F.col("quantity"), F.col("iso_common"), F.col("pll_common"))).select(F.col("id").alias("basis_id"))


def p2_units(spark: SparkSession, d: str) -> DataFrame:
    """What each unit spelling was taken for, and on what basis."""
    u = _harmonised(spark, d).units
    return u.select("quantity", "unit", F.round("scale", 6).alias("scale"), F.round("offset", 6).alias("offset"), "basis")


def p2_common(spark: SparkSession, d: str) -> DataFrame:
    """Both values of every quantity row in barg, °C or mm."""
    h = _harmonised(spark, d)
    return h.rows.select(F.col("id").alias("basis_id"), "quantity", F.round("iso_common", 6).alias("iso_common"), F.round("pll_common", 6).alias("pll_common"))


def p2_line_values(spark: SparkSession, d: str) -> DataFrame:
    """Quantities in the line tags in the common units, read with what all sources taught about spellings."""
    known = _harmonised(spark, d).units
    return units.convert(_line_fields(spark, d), known, "quantity", "text").select("tag_id", "field", "quantity", F.round("common", 6).alias("common"))


def p2_sheet_values(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of every ISO sheet's result in the common units."""
    sheets = materialise(_sheet_fields(spark, d), "sheet-fields")
    known = _harmonised(spark, d, sheets).units
    return units.convert(sheets, known, "quantity", "text").select("result_id", F.col("sheet_pos").cast("int"), F.col("result_pos").cast("int"), "line", "field", "quantity", F.round("common", 6).alias("common"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "extracted_tags")
    refs = references.citations(tags, table(spark, d, "extraction_results"), table(spark, d, "document_pages"))
    return references.orphans(refs, references.targets(table(spark, d, "project_documents"), tags))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "row_id", "ref_field")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return references.report(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_welds, p1_bom_items, *map(_tag_table, TAG_CHILDREN), p1_tag_elements, p2_found, p2_units, p2_common, p2_line_values, p2_sheet_values, p7_found, p7_report)}

_KEY = "regexp_replace(regexp_extract({v}, '([0-9]+)[^0-9]*$', 1), '^0+([0-9])', '\\1')"
#: Given: letters and digits are left that are not one of the words for "none".
_GIVEN = "upper(regexp_replace(coalesce({v}, ''), '[^A-Za-z0-9]', '', 'g')) NOT IN ('', 'NA', 'XX', 'NIL')"


def _p7_sql() -> str:
    cited = " UNION ALL ".join(
        f"SELECT id, document_id, created_at, '{f}' AS ref_field, '{k}' AS kind, json_extract_string(attributes, '$.{f}') AS v FROM extracted_tags WHERE tag_type = 'weld'"
        for f, k in (("spool_no", "spool"), ("weld_list_id", "weld_list_row"))
    )
    docs = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST(t.id AS VARCHAR) AS row_id, 'document_id' AS ref_field, {c} AS created_at FROM {t} t WHERE t.document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM project_documents p WHERE p.id = t.document_id)"
        for t, c in (("extracted_tags", "t.created_at"), ("extraction_results", "t.created_at"), ("document_pages", "CAST(NULL AS TIMESTAMP)"))
    )
    return f"""
    WITH targets AS (SELECT DISTINCT document_id, tag_type, {_KEY.format(v='tag_number')} AS n FROM extracted_tags WHERE tag_type IN ('spool', 'weld_list_row')),
    cited AS ({cited}),
    keyed AS (SELECT *, {_KEY.format(v='v')} AS n FROM cited WHERE {_GIVEN.format(v='v')}),
    orphans AS ({docs} UNION ALL
      SELECT 'extracted_tags', CAST(k.id AS VARCHAR), k.ref_field, k.created_at FROM keyed k
      WHERE k.n = '' OR NOT EXISTS (SELECT 1 FROM targets t WHERE t.document_id = k.document_id AND t.tag_type = k.kind AND t.n = k.n AND t.n <> ''))
    """


#: Elements of a field in whatever form, as arrays of JSON.
_FORMS = """CASE json_type({v}) WHEN 'ARRAY' THEN CAST({v} AS JSON[]) WHEN 'OBJECT' THEN [{v}]
  WHEN 'VARCHAR' THEN CASE WHEN json_valid({v} ->> '$') THEN CASE json_type(CAST({v} ->> '$' AS JSON)) WHEN 'ARRAY' THEN CAST(CAST({v} ->> '$' AS JSON) AS JSON[]) WHEN 'OBJECT' THEN [CAST({v} ->> '$' AS JSON)] END END END"""


def _elements_sql() -> str:
    """te(id, child, pos, v) of the tags and e(id, sheet_pos, child, pos, v) of the sheets in DuckDB."""
    sheets = " UNION ALL ".join(f"SELECT id, sheet_pos, '{c}' AS child, sheet -> '$.result.{c}' AS f FROM s" for c in SHEET_CHILDREN)
    bags = " UNION ALL ".join(f"SELECT id, '{c}' AS child, CAST(attributes AS JSON) -> '$.{c}' AS f FROM extracted_tags WHERE json_valid(attributes)" for c in TAG_CHILDREN)
    return f"""
    WITH r AS MATERIALIZED (SELECT id, {_FORMS.format(v="(CAST(raw_json AS JSON) -> '$.sheets')")} AS items FROM extraction_results WHERE json_valid(raw_json)),
    s AS (SELECT id, CAST(unnest(range(len(items))) AS INTEGER) AS sheet_pos, unnest(items) AS sheet FROM r),
    f AS MATERIALIZED ({sheets}),
    e AS (SELECT id, sheet_pos, child, CAST(unnest(range(len(x))) AS INTEGER) AS pos, unnest(x) AS v FROM (SELECT id, sheet_pos, child, {_FORMS.format(v='f')} AS x FROM f)),
    tf AS MATERIALIZED ({bags}),
    te AS (SELECT id, child, CAST(unnest(range(len(x))) AS INTEGER) AS pos, unnest(x) AS v FROM (SELECT id, child, {_FORMS.format(v='f')} AS x FROM tf))"""


def _p1_sql() -> str:
    return f"""{_elements_sql()}
    SELECT 'extraction_results' AS parent_table, id AS parent_id, sheet_pos, child, pos AS child_pos FROM e WHERE json_type(v) = 'OBJECT'
    UNION ALL SELECT 'extracted_tags', CAST(id AS VARCHAR), 0, child, pos FROM te WHERE json_type(v) = 'OBJECT'"""


# Declared fields of the elements.
_CLASS_ROW = ["description", "material", "size_min", "size_max"]
_DECLARED = {
    "welds": ["location_note", "size", "spool_no", "weld_list_id", "weld_tag", "weld_type"],
    "bom_items": ["component_type", "description", "item_no", "item_spec_class", "material", "quantity", "size"],
    "spec_breaks": ["location_note", "rating", "spec_class"],
} | {c: _CLASS_ROW for c in ("pipes", "fittings", "flanges", "valves")}
# End of fixed values.


def _flat_sql(child: str) -> str:
    fields = ", ".join(f"CASE WHEN json_type(v) = 'OBJECT' THEN v ->> '$.{c}' END AS {c}" for c in _DECLARED[child])
    source, place = ("e", "CAST(sheet_pos AS VARCHAR)") if child in SHEET_CHILDREN else ("te", "''")
    return f"{_elements_sql()} SELECT id, {place} AS parent_pos, pos, {fields}, CASE WHEN json_type(v) <> 'OBJECT' THEN v ->> '$' END AS scalar_text FROM {source} WHERE child = '{child}'"


_BLANKS = r"[\s\x{00a0}\x{2007}\x{202f}]+"


def _tidy_sql(v: str) -> str:
    return f"trim(regexp_replace({v}, '{_BLANKS}', ' ', 'g'))"


def _unit_sql(u: str) -> str:
    t = f"regexp_replace(lower({_tidy_sql(u)}), '\\(?\\b(max|min|approx|ca|note ?\\d*)\\b\\.?\\)?|\\bsee .*$', ' ', 'g')"
    t = f"regexp_replace(replace({t}, '²', '2'), chr(39) || chr(39) || '|”|″', '\"', 'g')"
    return f"regexp_replace(regexp_replace({t}, 'deg(\\.? ?[cfk])\\b', '\\1', 'g'), '[^a-z0-9/\"%]+', '', 'g')"


_GROUPED = lambda x: f"regexp_replace({x}, ',(\\d{{3}})([^\\d]|$)', '\\1\\2', 'g')"


def _p2_sql() -> str:
    """Units by their names: what the estimates must come to."""
    known = ", ".join(f"('{q}', '{k}', {s!r}::DOUBLE, {o!r}::DOUBLE)" for q, us in KNOWN_UNITS.items() for s, o, keys in us for k in keys)
    bare = ", ".join(f"('{q}', '', 1.0::DOUBLE, 0.0::DOUBLE)" for q in KNOWN_UNITS)
    parts = []
    for side in ("iso", "pll"):
        v, name = _tidy_sql(f"{side}_value"), side.upper()
        number = f"regexp_extract({v}, '[-+]?\\d+(?:[.,]\\d+)*')"
        missing = f"({side}_value IS NULL OR upper({v}) IN ('', 'NA', 'N/A', 'N.A.', 'NIL', 'NIL.', '-', '--', 'AMB', 'AMB.') OR regexp_matches(upper({v}), '^X+([.,]X+)?( .*)?$'))"
        beside = _unit_sql(f"regexp_extract({v}, '[-+]?\\d+(?:[.,]\\d+)*(.*)$', 1)")
        about = f"lower(regexp_extract(remarks, '(?i)\\b{side}\\s+(pressure|temperature|thickness|length)', 1))"
        said = _unit_sql(f"regexp_extract(remarks, '(?i)(?:\\bunit on {name}\\s*:\\s*|\\b{name}\\b[^;:]*?\\b(?:in|reads|is|are)\\s+)([^;]+)', 1)")
        note = f"coalesce(CASE WHEN {about} = '' OR replace({about}, 'thickness', 'length') = quantity THEN {said} END, '')"
        parts.append(f"CASE WHEN NOT {missing} THEN TRY_CAST(replace({_GROUPED(_GROUPED(number))}, ',', '.') AS DOUBLE) END AS {side}_n, CASE WHEN {beside} <> '' THEN {beside} ELSE {note} END AS {side}_u")
    return f"""WITH units(quantity, unit, s, o) AS (VALUES {known}, {bare}),
    b AS (SELECT *, CASE WHEN contains(lower(field), 'pressure') THEN 'pressure' WHEN contains(lower(field), 'temperature') THEN 'temperature' WHEN regexp_matches(lower(field), 'thickness|allowance') THEN 'length' END AS quantity FROM design_basis),
    v AS (SELECT id, quantity, {", ".join(parts)} FROM b WHERE quantity IS NOT NULL),
    c AS (SELECT v.id, v.quantity, v.iso_n * i.s + i.o AS a, v.pll_n * p.s + p.o AS b FROM v LEFT JOIN units i ON i.quantity = v.quantity AND i.unit = v.iso_u LEFT JOIN units p ON p.quantity = v.quantity AND p.unit = v.pll_u)"""


_P2 = _p2_sql()


def _stated_sql(source: str, keep: str, get: Callable[[str], str]) -> str:
    """Quantity fields of records in the common units, by the unit beside each value."""
    kind = lambda f: "pressure" if "pressure" in f else "temperature" if "temperature" in f else "length"
    rows = " UNION ALL ".join(f"SELECT {keep}, '{f}' AS field, '{kind(f)}' AS quantity, {get(f)} AS x FROM {source}" for f in LINE_FIELDS)
    t = _tidy_sql("x")
    missing = f"(upper({t}) IN ('', 'NA', 'N/A', 'N.A.', 'NIL', 'NIL.', '-', '--', 'AMB', 'AMB.') OR regexp_matches(upper({t}), '^X+([.,]X+)?( .*)?$'))"
    number = f"TRY_CAST(replace({_GROUPED(_GROUPED(f"regexp_extract({t}, '[-+]?\\d+(?:[.,]\\d+)*')"))}, ',', '.') AS DOUBLE)"
    beside = _unit_sql(f"regexp_extract({t}, '[-+]?\\d+(?:[.,]\\d+)*(.*)$', 1)")
    return f"""st AS ({rows}), sn AS (SELECT *, CASE WHEN NOT {missing} THEN {number} END AS n, {beside} AS u FROM st WHERE x IS NOT NULL),
    sc AS (SELECT sn.*, round(n * units.s + units.o, 6) AS common FROM sn LEFT JOIN units ON units.quantity = sn.quantity AND units.unit = sn.u)"""


_UNITS = _P2[: _P2.index("b AS (SELECT *, CASE WHEN contains")].strip()


_WS = r"[\s\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_DIFFER = "CASE WHEN quantity = 'temperature' THEN abs(a - b) > 1.0 + 1e-6 ELSE abs(a - b) > 0.01 * greatest(abs(a), abs(b)) + 1e-9 END"
ORACLE = {
    "p2_found": f"{_P2} SELECT id AS basis_id FROM c WHERE {_DIFFER}",
    "p2_common": f"{_P2} SELECT id AS basis_id, quantity, round(a, 6) AS iso_common, round(b, 6) AS pll_common FROM c",
    "p2_sheet_values": f"""{_UNITS} r AS MATERIALIZED (SELECT id, {_FORMS.format(v="(CAST(raw_json AS JSON) -> '$.sheets')")} AS items FROM extraction_results WHERE json_valid(raw_json)),
    s AS (SELECT id, CAST(unnest(range(len(items))) AS INTEGER) AS sheet_pos, unnest(items) AS sheet FROM r), q0 AS (SELECT id, sheet_pos, {_FORMS.format(v="(sheet -> '$.result')")} AS a FROM s),
    q1 AS (SELECT id AS result_id, sheet_pos, CAST(unnest(range(len(a))) AS INTEGER) AS result_pos, unnest(a) AS j FROM q0), q2 AS (SELECT *, upper(regexp_replace(j ->> '$.line_number', '^{_WS}+|{_WS}+$', '', 'g')) AS line FROM q1),
    {_stated_sql('q2', 'result_id, sheet_pos, result_pos, line', lambda f: f"j ->> '$.{f}'")} SELECT result_id, sheet_pos, result_pos, line, field, quantity, common FROM sc""",
    "p2_line_values": f"{_UNITS} {_stated_sql("(SELECT * FROM extracted_tags WHERE tag_type = 'line' AND json_valid(attributes))", 'id AS tag_id', lambda f: f"json_extract_string(attributes, '$.{f}')")} SELECT tag_id, field, quantity, common FROM sc",
    "p1_found": _p1_sql(),
    **{f"p1_{c}": _flat_sql(c) for c in _DECLARED},
    "p7_found": _p7_sql() + "SELECT table_name, row_id, ref_field FROM orphans",
    "p7_report": _p7_sql() + "SELECT table_name, ref_field, strftime(created_at, '%Y-%m') AS month, count(*) AS orphans FROM orphans GROUP BY ALL",
}
