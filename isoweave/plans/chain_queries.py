"""The staged findings of isometrics and the design basis, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import gates as G
from ..runtime import table
from . import scalar_queries as X
from .scalar_queries import bag, blank, key, q, trim

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


_FILL = lambda f, n: f"CASE WHEN ok AND {blank(f)} AND p[{n}] IS NOT NULL THEN p[{n}] ELSE {f} END AS {f}"
_DONE = {
    "size": f"CASE WHEN ok AND {blank('sz')} THEN p[1] || ' mm' WHEN ok AND regexp_matches(sz, '^\\d+(\\.\\d+)?$') AND TRY_CAST(sz AS DOUBLE) = TRY_CAST(p[1] AS DOUBLE) THEN sz || ' mm' ELSE size END AS size",
    "service": _FILL("service", 2), "spec_class": _FILL("spec_class", 3), "insul_spec": _FILL("insul_spec", 5), "heat_trace": _FILL("heat_trace", 6),
}
ISO = f"""t0 AS (SELECT *, list_filter(list_transform(string_split({trim('tag_number')}, '-'), lambda x: trim(x)), lambda x: x <> '') AS p FROM {bag('b', G.ISO_FIELDS, "tag_type = 'line' AND doc_type = 'iso'")}),
t1 AS (SELECT *, len(p) >= 4 AND regexp_matches(p[1], '^[0-9]+$') AS ok, coalesce({trim('size')}, '') AS sz FROM t0),
i AS (SELECT id, project_id, document_id, tag_number, {key('tag_number')} AS k, ok, TRY_CAST(p[1] AS DOUBLE) AS mm, p[1] || ' mm' AS dsize, p[3] AS dclass, {', '.join(_DONE.get(f, f) for f in G.ISO_FIELDS)} FROM t1)"""
_LISTED = lambda fn: f"l AS (SELECT project_id, {key('tag_number')} AS k, count(*) AS n, {fn}(struct_pack({', '.join(f'{f} := {f}' for f in G.LIST_FIELDS)}), id) AS l FROM {bag('b', G.LIST_FIELDS, '''tag_type = 'line' AND doc_type = 'pll' ''')} GROUP BY ALL)"


def _stack(fields, source: str, keep: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {keep}, {q(f[0])} AS name, {str(f[3]).lower()} AS numeric, {source}.{f[1]} AS iso_value, {source}.l.{f[2]} AS pll_value FROM {source}" for f in fields)
    return f"""st AS (SELECT *, {X.num('iso_value')} AS na, {X.num('pll_value')} AS nb, {X.unit('iso_value')} AS ua, {X.unit('pll_value')} AS ub FROM ({rows})),
    sv AS (SELECT *, CASE WHEN numeric THEN {X._verdict_sql(True)} ELSE {X._verdict_sql(False)} END AS status FROM st)"""


@query(f"WITH {ISO}, {_LISTED('arg_max')}, j AS (SELECT i.*, l.l FROM i JOIN l ON l.project_id = i.project_id AND l.k = i.k), {_stack(G.BASIS, 'j', 'id')} SELECT id AS tag_id, name AS field, iso_value, pll_value, status FROM sv")
def check_design_basis(spark, d):
    """The fourteen rows of the design basis of every line against the last row of the line list."""
    return G.design_basis(table(spark, d, "extracted_tags"))


_KEYS = lambda v: f"regexp_replace({key(f'''coalesce({v}, '')''')}, '[^A-Z0-9\"]', '', 'g')"
_BREAKS = "CASE WHEN json_valid(attributes) AND json_type(CAST(attributes AS JSON) -> '$.spec_breaks') = 'ARRAY' THEN CAST(CAST(attributes AS JSON) -> '$.spec_breaks' AS JSON[]) ELSE [] END"
_SEVERITY = "CASE name " + " ".join(f"WHEN {q(c[0])} THEN {q(c[4])}" for c in G.COMPARED) + " END"
_CODED = "coalesce(spec_class, '') <> ''"


@query(f"""WITH {ISO}, {_LISTED('arg_min')},
hd AS (SELECT project_id, bool_or(doc_type = 'pll') AS pll, bool_or(doc_type = 'pid') AS pid, bool_or(doc_type = 'ga') AS ga, bool_or(doc_type = 'spec_sheet') AS spec FROM extracted_tags GROUP BY project_id),
ot AS (SELECT project_id, {key('tag_number')} AS k, bool_or(doc_type = 'pid') AS on_pid, bool_or(doc_type = 'ga') AS on_ga FROM extracted_tags WHERE tag_type = 'line' AND doc_type IN ('pid', 'ga') GROUP BY ALL),
sc AS (SELECT DISTINCT project_id, {key('tag_number')} AS c FROM extracted_tags WHERE tag_type = 'spec_class'),
br AS (SELECT id, {_BREAKS} AS b FROM extracted_tags WHERE tag_type = 'line' AND doc_type = 'iso'),
j0 AS (SELECT i.*, l.n, l.l, coalesce(hd.pll, false) AS pll, coalesce(hd.pid, false) AS pid, coalesce(hd.ga, false) AS ga, coalesce(hd.spec, false) AS spec, coalesce(on_pid, false) AS on_pid, coalesce(on_ga, false) AS on_ga, br.b, min(i.id) OVER (PARTITION BY i.document_id) AS first_id,
  sc.c IS NOT NULL AS classed FROM i LEFT JOIN l ON l.project_id = i.project_id AND l.k = i.k LEFT JOIN hd ON hd.project_id = i.project_id LEFT JOIN ot ON ot.project_id = i.project_id AND ot.k = i.k LEFT JOIN br ON br.id = i.id LEFT JOIN sc ON sc.project_id = i.project_id AND sc.c = {key('i.spec_class')}),
j1 AS (SELECT *, pll AND n IS NULL AS missing, coalesce(pll AND n IS NOT NULL AND NOT {blank('spec_class')} AND NOT {blank('l.spec_class')} AND {key('spec_class')} <> {key('l.spec_class')}, false) AS clash FROM j0),
j AS (SELECT *, NOT bool_or(missing) OVER w AS go2, NOT bool_or(missing) OVER w AND NOT bool_or(clash) OVER w AS go3, pll AND n IS NOT NULL AS listed FROM j1 WINDOW w AS (PARTITION BY document_id)),
jl AS (SELECT * FROM j WHERE listed), {_stack(G.COMPARED, 'jl', 'id, document_id, go2, clash')},
bi AS (SELECT * FROM {bag('b', ['component_type', 'description', 'line_number', 'item_code'], "tag_type = 'bom_item' AND doc_type = 'iso'")}),
bb AS (SELECT document_id, {key('line_number')} AS k, max(CASE WHEN contains(t, 'flange') THEN r END) AS flange, max(CASE WHEN contains(t, 'gasket') THEN r END) AS gasket FROM (SELECT *, lower(coalesce(component_type, '') || ' ' || coalesce(description, '')) AS t, {X.rating("(coalesce(description, '') || ' ' || coalesce(item_code, ''))")} AS r FROM bi) GROUP BY ALL),
nd AS (SELECT j.id, j.document_id, j.k, list_filter(list_transform(b, lambda x: TRY_CAST(x ->> '$.rating' AS DOUBLE)), lambda r: r IS NOT NULL) AS rs FROM j WHERE go3 AND spec AND len(b) > 1),
ne AS (SELECT nd.id, nd.document_id, list_max(rs) AS need, flange, gasket FROM nd LEFT JOIN bb ON bb.document_id = nd.document_id AND bb.k = nd.k WHERE len(rs) > 1 AND list_max(rs) <> list_min(rs)),
eb AS (SELECT id, document_id, project_id, spec_class, unnest(b) ->> '$.spec_class' AS bc FROM j WHERE go3 AND spec AND {_CODED} AND len(b) > 1)
{' '.join(f"SELECT document_id, id AS tag_id, '0.{f}' AS field_checked, 'warning' AS severity, NULL AS value_a, NULL AS value_b FROM j WHERE {blank(f)} UNION ALL" for f in G.TITLE)}
SELECT document_id, id, '1.line_exists', 'info', NULL, NULL FROM j WHERE NOT pll AND id = first_id
UNION ALL SELECT document_id, id, '1.line_exists', 'error', tag_number, NULL FROM j WHERE missing
UNION ALL SELECT document_id, id, '1.duplicates', 'warning', tag_number, CAST(n AS VARCHAR) FROM j WHERE listed AND n > 1
UNION ALL SELECT document_id, id, '1.decode_size', 'warning', size, dsize FROM j WHERE listed AND ok AND {X.num('size')} <> mm
UNION ALL SELECT document_id, id, '1.decode_class', 'warning', spec_class, dclass FROM j WHERE listed AND ok AND NOT {blank('spec_class')} AND {key('spec_class')} <> {key('dclass')}
{' '.join(f"UNION ALL SELECT document_id, id, {q(c)}, 'warning', {f}, tag_number FROM j WHERE listed AND NOT coalesce(ok, false) AND NOT {blank(f)} AND NOT contains({_KEYS('tag_number')}, {_KEYS(f)})" for c, f in (('1.decode_size', 'size'), ('1.decode_class', 'spec_class')))}
UNION ALL SELECT document_id, id, '2.piping_class', 'error', spec_class, l.spec_class FROM j WHERE go2 AND clash
UNION ALL SELECT document_id, id, name, {_SEVERITY}, iso_value, pll_value FROM sv WHERE status = 'mismatch' AND (name LIKE '1.%' OR (go2 AND NOT clash))
UNION ALL SELECT document_id, id, '3.line_on_pid', 'error', tag_number, NULL FROM j WHERE go3 AND pid AND NOT on_pid
UNION ALL SELECT document_id, id, '4.spec_class', 'error', spec_class, NULL FROM j WHERE go3 AND spec AND {_CODED} AND NOT classed
UNION ALL SELECT document_id, id, '4.break_spec_class', 'error', bc, NULL FROM eb WHERE NOT {blank('bc')} AND {key('bc')} <> {key('spec_class')} AND NOT EXISTS (SELECT 1 FROM sc WHERE sc.project_id = eb.project_id AND sc.c = {key('eb.bc')})
{' '.join(f"UNION ALL SELECT document_id, id, '4.break_{w}_rating', 'error', CAST({w} AS VARCHAR) || '#', CAST(CAST(need AS INTEGER) AS VARCHAR) || '#' FROM ne WHERE {w} < need" for w in ('flange', 'gasket'))}
UNION ALL SELECT bi.document_id, bi.id, '6.support_type', 'warning', coalesce(description, ''), NULL FROM bi WHERE contains(lower(component_type), 'support') AND NOT regexp_matches(coalesce(description, ''), {q(G.SUPPORT_TYPE)}) AND document_id IN (SELECT document_id FROM j GROUP BY document_id HAVING bool_and(go3))
UNION ALL SELECT document_id, id, '8.line_routing', 'warning', tag_number, NULL FROM j WHERE go3 AND ga AND NOT on_ga""")
def check_findings(spark, d):
    """Staged findings of every isometric against the lists, diagrams, classes and arrangements of its project."""
    return G.findings(table(spark, d, "extracted_tags"))

