"""Rules, constraints, tenancy and streams, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..runtime import table
from ..streaming import jobs
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


_SIDE = lambda doc: f"SELECT project_id, {key('tag_number')} AS tag_key, arg_min(struct_pack(v := design_temperature), id).v AS v FROM {bag('b', ['design_temperature'], f'''tag_type = 'line' AND doc_type = '{doc}' ''')} GROUP BY ALL"


@query(f"""SELECT a.project_id, a.tag_key, a.v AS value_a, b.v AS value_b, upper({trim('a.v')}) = upper({trim('b.v')}) AS passed FROM ({_SIDE('iso')}) a JOIN ({_SIDE('pll')}) b USING (project_id, tag_key) WHERE a.v IS NOT NULL AND b.v IS NOT NULL""")
def rule_equality(spark, d):
    t = table(spark, d, "extracted_tags").filter("tag_type = 'line'")
    return rules.evaluate_equality(t, {"check_type": "field_equality", "field": "design_temperature", "doc_type_a": "iso", "doc_type_b": "pll"})


RULES = [
    {"name": "size stated", "check_type": "field_presence", "required_field": "size", "tag_type": "line", "severity": "error"},
    {"name": "weld size as DN", "check_type": "regex_format", "field": "size", "pattern": "^DN[0-9]+$", "tag_type": "weld"},
    {"name": "cut length", "check_type": "value_range", "field": "cut_length_mm", "min": 100, "max": 2500, "tag_type": "cut_piece"},
    {"name": "shop list", "check_type": "custom_expression", "expression": "category = 'SHOP' or category is null", "tag_type": "weld_list_row"},
]


@query(f"""SELECT 'size stated' AS rule, id, 'error' AS severity FROM {bag('b', ['size'], "tag_type = 'line'")} WHERE {blank('size')}
UNION ALL SELECT 'weld size as DN', id, 'warning' FROM {bag('b', ['size'], "tag_type = 'weld'")} WHERE NOT regexp_matches(size, '^DN[0-9]+$')
UNION ALL SELECT 'cut length', id, 'warning' FROM {bag('b', ['cut_length_mm'], "tag_type = 'cut_piece'")} WHERE TRY_CAST(cut_length_mm AS DOUBLE) < 100 OR TRY_CAST(cut_length_mm AS DOUBLE) > 2500
UNION ALL SELECT 'shop list', id, 'warning' FROM {bag('b', ['category'], "tag_type = 'weld_list_row'")} WHERE NOT (category = 'SHOP' OR category IS NULL)""")
def rule_single_tags(spark, d):
    return rules.evaluate(table(spark, d, "extracted_tags"), RULES)


@query("SELECT document_id, page_number, count(*) AS n FROM document_pages GROUP BY ALL HAVING count(*) > 1")
def con_double_pages(spark, d):
    return table(spark, d, "document_pages").groupBy("document_id", "page_number").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT project_id, file_hash, count(*) AS n, min(id) AS kept FROM project_documents GROUP BY ALL HAVING count(*) > 1")
def con_double_files(spark, d):
    """Files uploaded more than once into a project; the first holds."""
    return table(spark, d, "project_documents").groupBy("project_id", "file_hash").agg(F.count("*").alias("n"), F.min("id").alias("kept")).filter("n > 1")


# Document types.
DOC_TYPES = ("iso", "pid", "pid_legend", "pll", "hmb", "pfd", "ga", "spec_sheet")
# End of fixed values.


def bad_document() -> Column:
    return F.col("doc_type").isNull() | ~F.col("doc_type").isin(*DOC_TYPES) | (F.col("page_count") < 1) | ~F.lower("file_name").rlike(r"\.(pdf|csv|xlsx)$")


def foreign_path() -> Column:
    return ~F.split("storage_path", "/")[0].eqNullSafe(F.col("project_id"))


@query(f"SELECT id, doc_type FROM project_documents WHERE doc_type IS NULL OR doc_type NOT IN ({', '.join(map(q, DOC_TYPES))}) OR page_count < 1 OR NOT regexp_matches(lower(file_name), '\\.(pdf|csv|xlsx)$')")
def con_documents(spark, d):
    """Documents of an unknown type, without pages, or of a file kind that has no reader."""
    return table(spark, d, "project_documents").filter(bad_document()).select("id", "doc_type")


@query("SELECT id FROM project_documents WHERE string_split(storage_path, '/')[1] IS DISTINCT FROM project_id")
def ten_foreign_paths(spark, d):
    """Files stored outside their project's folder."""
    return table(spark, d, "project_documents").filter(foreign_path()).select("id")


@query("""SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE c.c_custkey = o.o_custkey AND r.r_name IN ('ASIA', 'EUROPE'))""")
def ten_visible_rows(spark, d):
    """Rows that a member of two organisations sees, through three tables (organisations by region)."""
    r = table(spark, d, "region").filter(F.col("r_name").isin("ASIA", "EUROPE"))
    n = table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


_STATE = {"view": "queued", "click": "running", "purchase": "succeeded", "error": "failed"}


@query(f"""WITH s AS (SELECT user_id, ts, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATE.items())} END AS state FROM events)
SELECT user_id, arg_max(state, (ts, state)) AS state, max(ts) AS since, count(*) AS events FROM s WHERE state IS NOT NULL GROUP BY user_id""")
def stream_job_states(spark, d):
    state = F.create_map(*[F.lit(x) for kv in _STATE.items() for x in kv])[F.col("event_type")]
    return jobs.settle(jobs.job_states(jobs.read_events(spark, d), "user_id", "ts", state), ["user_id"], "states")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    return jobs.settle(jobs.windowed_counts(jobs.read_events(spark, d), "ts", "event_type", "6 hours", "1 day"), ["start", "event_type"], "windows")
