"""Queries of the problems on records and texts, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import canonical, collapse, leakage, linkage, packing, reading, split


def _links(spark: SparkSession, d: str) -> linkage.Links:
    return linkage.link(table(spark, d, "sheet_items"), table(spark, d, "bom_rows"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).pairs.select("item_id", "bom_id")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Each pair with its confidence."""
    return _links(spark, d).pairs.select("item_id", "bom_id", F.round("confidence", 4).alias("confidence"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of descriptions that match, with the rows of either side that have it."""
    return _links(spark, d).classes.withColumn("confidence", F.round("confidence", 4))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse.tag_copies(table(spark, d, "extracted_tags"))


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One row per group of copies with its number of copies."""
    tags = table(spark, d, "extracted_tags")
    return collapse.collapse(tags, collapse.tag_copies(tags)).select("id", "document_id", "tag_type", "source_page", "copies")


def _values(spark: SparkSession, d: str) -> DataFrame:
    return canonical.domain_values({t: table(spark, d, t) for _, t, _ in canonical.SOURCES})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(_values(spark, d), table(spark, d, "canonical_terms")).select("source_field", "row_id", "term_id")


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values without a term, with the number of rows that hold them."""
    mapped = canonical.map_values(_values(spark, d), table(spark, d, "canonical_terms"))
    return mapped.filter("term_id = 0").groupBy("source_field", canonical.normalise(F.col("value")).alias("value")).agg(F.count("*").alias("rows"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.pieces(table(spark, d, "extraction_results"), table(spark, d, "document_pages"), table(spark, d, "size_limits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select("item_kind", "owner_id", "sheet_pos").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces with their places in the item."""
    return _pieces(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing had to cut for the largest container."""
    largest = max(packing.token_limits(table(spark, d, "size_limits")), key=lambda x: x[1])
    packed = packing.pack(packing.count_tokens(table(spark, d, "documents")), [largest])
    return packed.filter("piece > 0").select("doc_id").distinct()


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of its pieces, for each token limit."""
    lims = packing.token_limits(table(spark, d, "size_limits"))
    return packing.pack(packing.count_tokens(table(spark, d, "documents")), lims)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_matches(spark: SparkSession, d: str) -> DataFrame:
    """Phrase and proximity matches with the number of words and the place in the document."""
    return leakage.matches(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).filter("level = 4").select("doc_id")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Level of every English prose document with the share of each level."""
    found = reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).filter("level is not null")
    return found.select("doc_id", "level", *[F.round(f"p{k}", 3).alias(f"p{k}") for k in (1, 2, 3, 4)], "words")


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_links, p3_classes, p4_found, p4_collapsed, p5_found, p5_pieces, p6_found, p6_unmatched, p8_found, p8_packed, p9_found, p9_matches, p10_found, p10_levels)
}
# p5_found in SQL: lengths of texts and of joined pages.
_P5 = """
WITH best AS (SELECT document_id, page_number, arg_max(coalesce(length(page_text), 0), id) AS len FROM document_pages GROUP BY ALL),
r AS MATERIALIZED (SELECT id, document_id, CAST(raw_json AS JSON) -> '$.locate.sheets' AS s FROM extraction_results WHERE json_valid(raw_json)),
a AS MATERIALIZED (SELECT id, document_id, CASE json_type(s) WHEN 'ARRAY' THEN CAST(s AS JSON[]) WHEN 'OBJECT' THEN [s] END AS items FROM r),
e AS (SELECT id, document_id, CAST(unnest(range(len(items))) AS INTEGER) AS sheet_pos, unnest(items) AS v FROM a),
p AS (SELECT id, document_id, sheet_pos, TRY_CAST(v ->> '$.pages.start' AS INTEGER) AS first, TRY_CAST(v ->> '$.pages.end' AS INTEGER) AS last FROM e)
SELECT 'page' AS item_kind, CAST(id AS VARCHAR) AS owner_id, 0 AS sheet_pos FROM document_pages WHERE length(page_text) > (SELECT capacity FROM size_limits WHERE limit_id = 1)
UNION ALL
SELECT 'sheet', p.id, p.sheet_pos FROM p JOIN best b ON b.document_id = p.document_id AND b.page_number BETWEEN p.first AND p.last
GROUP BY p.id, p.sheet_pos HAVING sum(b.len) > (SELECT capacity FROM size_limits WHERE limit_id = 2)"""
# p9_found in SQL: equality of all 12-word windows.
_P9 = """
WITH w AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM eval_items),
g AS (SELECT DISTINCT id AS item_id, array_to_string(ws[i:i+11], ' ') AS gram FROM (SELECT id, ws, unnest(range(1, len(ws) - 10)) AS i FROM w WHERE len(ws) >= 12)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, array_to_string(ws[i:i+11], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM d WHERE len(ws) >= 12))
SELECT DISTINCT g.item_id, h.doc_id FROM h JOIN g USING (gram)"""
ORACLE: dict[str, str] = {"p5_found": _P5, "p9_found": _P9}
