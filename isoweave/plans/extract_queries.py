"""Extraction output to tags, joined page texts, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as E
from ..runtime import table
from ..sources import pages as P
from . import scalar_queries as X
from .core_problems import _FORMS
from .scalar_queries import key, q, trim

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


_CELL = lambda v: f"nullif(array_to_string(list_filter(list_transform(regexp_split_to_array({v}, '\\r?\\n'), lambda y: {trim('y')}), lambda y: y <> ''), ' / '), '')"
_SHOWN = ["line_number", "size", "spool_no", "component_type", "item_spec_class", "item_spec_basis", "weld_type", "weld_list_id", "nd", "boundary_note", "location_note", "spec_class", "service", "slope"]
_SHEETS = f"""rr AS MATERIALIZED (SELECT id, document_id, schema_version, CAST(raw_json AS JSON) AS j FROM extraction_results WHERE json_valid(raw_json)),
sh0 AS (SELECT id, document_id, schema_version, {_FORMS.format(v="(j -> '$.sheets')")} AS a FROM rr),
sh AS MATERIALIZED (SELECT id, document_id, schema_version, CAST(unnest(range(len(a))) AS INTEGER) AS sheet_pos, unnest(a) AS s FROM sh0)"""
_ARR = " UNION ALL ".join(f"SELECT id, document_id, sheet_pos, page, line, class, drawing, br, {q(t)} AS tag_type, {_FORMS.format(v=f'''(r -> '$.{a}')''')} AS a FROM rs" for a, t, _, _, _ in E.ISO_ARRAYS)
_NUMBER = "CASE tag_type " + " ".join(f"WHEN {q(t)} THEN " + (f"x ->> '$.{f}'" if t == "bom_item" else "coalesce(" + ", ".join(([_CELL(f"(x ->> '$.{f}')")] if f else []) + ([f"{q(p)} || page || '-' || (pos + 1)"] if p else ["NULL"])) + ")") for _, t, f, p, _ in E.ISO_ARRAYS) + " END"
_TOLD = "(coalesce(x ->> '$.description', '') || ' ' || coalesce(x ->> '$.item_code', ''))"
_OWN = _CELL("(x ->> '$.item_spec_class')")
_HITS = f"list_filter(br, lambda b: b.rating = {X.rating(_TOLD)})"
_BY = f"CASE WHEN len(br) >= 2 AND NOT contains(lower({_TOLD}), 'orifice') AND len({_HITS}) = 1 THEN ({_HITS})[1].spec_class END"
_IN = {t: set(f) for _, t, _, _, f in E.ISO_ARRAYS}


def _field(f: str) -> str:
    if f == "line_number":
        return "line AS line_number"
    if f == "item_spec_class":
        return f"CASE WHEN tag_type = 'bom_item' THEN coalesce({_OWN}, {_BY}) END AS item_spec_class"
    if f == "item_spec_basis":
        return f"CASE WHEN tag_type = 'bom_item' THEN coalesce({_CELL('''(x ->> '$.item_spec_basis')''')}, CASE WHEN {_OWN} IS NULL AND ({_BY}) IS NOT NULL THEN 'rating' END) END AS item_spec_basis"
    if f == "spec_class":
        return "CASE WHEN tag_type = 'bom_item' THEN class END AS spec_class"
    kinds = ", ".join(q(t) for t, fs in _IN.items() if f in fs)
    return f"CASE WHEN tag_type IN ({kinds}) THEN {_CELL(f'''(x ->> '$.{f}')''')} END AS {f}" if kinds else f"NULL AS {f}"


_P = f"list_filter(list_transform(string_split({trim('num')}, '-'), lambda y: trim(y)), lambda y: y <> '')"
_LINE = {
    "line_number": "NULL", "size": f"CASE WHEN ok AND {X.blank('sz')} THEN p[1] || ' mm' WHEN ok AND regexp_matches(sz, '^\\d+(\\.\\d+)?$') AND TRY_CAST(sz AS DOUBLE) = TRY_CAST(p[1] AS DOUBLE) THEN sz || ' mm' ELSE size END",
    "spec_class": f"CASE WHEN ok AND {X.blank('spec_class')} THEN p[3] ELSE spec_class END", "service": f"CASE WHEN ok AND {X.blank('service')} THEN p[2] ELSE service END",
    "slope": f"CASE WHEN {trim('slope')} = '' THEN NULL WHEN regexp_matches({trim('slope')}, {q(T.SLOPE)}) THEN regexp_extract({trim('slope')}, {q(T.SLOPE)}, 1) || ':' || regexp_extract({trim('slope')}, {q(T.SLOPE)}, 2) ELSE {trim('slope')} END",
}


@query(f"""WITH {_SHEETS},
rs0 AS (SELECT id, document_id, sheet_pos, TRY_CAST(s ->> '$.pageNumber' AS INTEGER) AS page, s ->> '$.drawing_number' AS drawing, CASE json_type(s -> '$.result') WHEN 'OBJECT' THEN s -> '$.result' WHEN 'VARCHAR' THEN CASE WHEN json_valid(s ->> '$.result') THEN CAST(s ->> '$.result' AS JSON) END END AS r FROM sh WHERE schema_version LIKE 'iso.%'),
rs AS MATERIALIZED (SELECT *, r ->> '$.line_number' AS line, r ->> '$.spec_class' AS class, list_transform(coalesce({_FORMS.format(v="(r -> '$.spec_breaks')")}, []), lambda b: struct_pack(spec_class := b ->> '$.spec_class', rating := coalesce({X.rating("(b ->> '$.rating')")}, nullif(TRY_CAST(regexp_replace(b ->> '$.rating', '\\D', '', 'g') AS INTEGER), 0)))) AS br FROM rs0 WHERE json_type(r) = 'OBJECT'),
ar AS MATERIALIZED ({_ARR}),
el AS (SELECT id, document_id, sheet_pos, page, line, class, br, tag_type, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS x FROM ar),
tn AS (SELECT *, {_NUMBER} AS num FROM el WHERE json_type(x) = 'OBJECT'),
l0 AS (SELECT id, document_id, sheet_pos, page, coalesce({_CELL('line')}, line) AS num, {', '.join(f"{_CELL(f'''(r ->> '$.{f}')''')} AS {f}" for f in ('size', 'spec_class', 'service', 'slope'))} FROM rs WHERE line <> ''),
l1 AS (SELECT *, coalesce(size, '') AS sz, {_P} AS p, len({_P}) >= 4 AND regexp_matches(({_P})[1], '^[0-9]+$') AS ok FROM l0)
SELECT id AS result_id, sheet_pos, pos, page, tag_type, num AS tag_number, {key('num')} AS tag_key, {', '.join(map(_field, _SHOWN))} FROM tn WHERE tag_type <> 'spool' OR num IS NOT NULL
UNION ALL SELECT id, sheet_pos, 0, page, 'line', num, {key('num')}, {', '.join(f"{_LINE.get(f, 'NULL')}" for f in _SHOWN)} FROM l1""")
def flat_iso_tags(spark, d):
    """All tags of the ISO sheets with the attributes that several kinds share."""
    t = E.iso_tags(table(spark, d, "extraction_results").filter(F.col("schema_version").startswith("iso.")))
    return t.select("result_id", "sheet_pos", "pos", "page", "tag_type", "tag_number", "tag_key", *[F.try_element_at("attributes", F.lit(f)).alias(f) for f in _SHOWN])


_KIND = lambda pick: "CASE " + " ".join(f"WHEN list_contains(ks, {q(f)}) THEN {pick(f, t, n)}" for f, t, n in E.THINGS) + " END"


@query(f"""WITH {_SHEETS},
i0 AS (SELECT id, sheet_pos, TRY_CAST(s ->> '$.pageNumber' AS INTEGER) AS page, {_FORMS.format(v="(s -> '$.items')")} AS a FROM sh WHERE schema_version LIKE 'pid.%' OR schema_version LIKE 'pfd.%' OR schema_version LIKE 'ga.%' OR schema_version LIKE 'hmb.%'),
i1 AS (SELECT id, sheet_pos, page, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS x FROM i0), i2 AS (SELECT *, json_keys(x) AS ks FROM i1 WHERE json_type(x) = 'OBJECT'),
i3 AS (SELECT *, {_KIND(lambda f, t, n: q(t))} AS tag_type, {_KIND(lambda f, t, n: "coalesce(" + ", ".join(_CELL(f"(x ->> '$.{c}')") for c in n) + f", {q(t)})")} AS num FROM i2)
SELECT id AS result_id, sheet_pos, pos, page, tag_type, num AS tag_number, {key('num')} AS tag_key, {_CELL("(x ->> '$.line_number')")} AS line_number, {_CELL("(x ->> '$.quantity')")} AS quantity FROM i3 WHERE tag_type IS NOT NULL""")
def flat_listed_things(spark, d):
    """Valves, instruments, equipment and streams of diagrams, arrangements and balances."""
    r = table(spark, d, "extraction_results").filter(F.split("schema_version", r"\.")[0].isin("pid", "pfd", "ga", "hmb"))
    return E.listed_things(r).select("result_id", "sheet_pos", "pos", "page", "tag_type", "tag_number", "tag_key", *[F.try_element_at("attributes", F.lit(f)).alias(f) for f in ("line_number", "quantity")])


@query(f"""WITH rr AS MATERIALIZED (SELECT id, CAST(raw_json AS JSON) AS j FROM extraction_results WHERE json_valid(raw_json) AND schema_version LIKE 'spec_sheet.%'),
c0 AS (SELECT id, j, {_FORMS.format(v="(j -> '$.classes')")} AS a FROM rr), c1 AS (SELECT id, j, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) ->> '$.class_code' AS class_code FROM c0),
dk AS (SELECT id, unnest(json_keys(j, '$.detail')) AS k FROM rr WHERE json_type(j -> '$.detail') = 'OBJECT'),
dx AS (SELECT dk.id, {key('k')} AS kk, j -> ('$.detail."' || k || '"') AS x FROM dk JOIN rr USING (id))
SELECT c1.id AS result_id, pos, class_code, x IS NOT NULL AS detailed, x ->> '$.service' AS service, {', '.join(f"CAST(coalesce(len({_FORMS.format(v=f'''(x -> '$.{a}')''')}), 0) AS INTEGER) AS {a}" for a in ('pipes', 'fittings', 'flanges', 'valves'))} FROM c1 LEFT JOIN dx ON dx.id = c1.id AND dx.kk = {key('class_code')}""")
def flat_spec_classes(spark, d):
    """Classes of the specification sheets with the number of rows in each array of their details."""
    c = E.spec_classes(table(spark, d, "extraction_results").filter(F.col("schema_version").startswith("spec_sheet.")))
    return c.select("result_id", "pos", "class_code", "detailed", "service", *[F.size(a).alias(a) for a in ("pipes", "fittings", "flanges", "valves")])


_PAGE = "'=== Page ' || page_number || ' ===' || chr(10) || coalesce(page_text, '')"


@query(f"SELECT document_id, count(*) AS pages, md5(string_agg({_PAGE}, chr(10) || chr(10) ORDER BY page_number, id)) AS text_md5 FROM document_pages WHERE document_id IS NOT NULL GROUP BY document_id")
def src_document_texts(spark, d):
    """Numbered pages of every document as one text in page order (shown by its digest)."""
    return P.joined(table(spark, d, "document_pages"), ["document_id"]).select("document_id", "pages", F.md5("text").alias("text_md5"))


@query(f"""WITH r9 AS MATERIALIZED (SELECT id, document_id, CAST(raw_json AS JSON) AS j FROM extraction_results WHERE json_valid(raw_json)),
lo AS (SELECT id, document_id, {_FORMS.format(v="(j -> '$.locate.sheets')")} AS a FROM r9), le AS (SELECT id, document_id, CAST(unnest(range(len(a))) AS INTEGER) AS sheet_pos, unnest(a) AS x FROM lo),
lr AS (SELECT id, document_id, sheet_pos, TRY_CAST(x ->> '$.pages.start' AS INTEGER) AS first, TRY_CAST(x ->> '$.pages.end' AS INTEGER) AS last FROM le)
SELECT lr.id AS owner_id, sheet_pos, count(*) AS pages, md5(string_agg({_PAGE}, chr(10) || chr(10) ORDER BY page_number, p.id)) AS text_md5 FROM lr JOIN document_pages p ON p.document_id = lr.document_id AND p.page_number BETWEEN first AND last GROUP BY ALL""")
def src_sheet_texts(spark, d):
    """Numbered pages of every located sheet's range as one text."""
    return P.sliced(table(spark, d, "extraction_results"), table(spark, d, "document_pages")).select("owner_id", "sheet_pos", "pages", F.md5("text").alias("text_md5"))
