"""Page texts: spreadsheets kept as tab-separated pages, numbered pages, page ranges of located sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_null, trimmed
from ..operators import shred

# Header words of the two sheet shapes, by field.
ITEM_LIST = {"reference": "spref", "spec_code": "spec of", "type": "gtype", "catalogue_ref": "catalogue", "description": "detailing text", "material": "material text", "size_p1": "size p1", "size_p2": "size p2", "size_p3": "size p3"}
CATALOGUE = {"code": "itemcode", "sizes": "sizes", "catalogue_ref": "catalogpartid", "material": "material", "description": "shortdescription", "size_p1": "nominaldiameter"}
# End of fixed values.


def page_kind(file_name: Column) -> Column:
    """pdf, xlsx or csv reader of a file by its name."""
    n = F.lower(file_name)
    return F.when(n.endswith(".xlsx"), "xlsx").when(n.endswith(".csv"), "csv").otherwise("pdf")


def grid(pages: DataFrame) -> DataFrame:
    """(id, worksheet, headers, row_no, cells): rows of tab-separated pages from 0; pages of fewer than two lines have none."""
    first = F.split("page_text", "\n")[0]
    name = F.regexp_extract(first, r"^\[Worksheet: (.*)\]$", 1)
    named = first.rlike(r"^\[Worksheet: .*\]$")
    lines = F.split("page_text", "\n")
    data = F.filter(F.when(named, F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines), lambda x: x != "")
    src = pages.filter(F.col("page_text").contains("\t")).select("id", F.when(named, name).alias("worksheet"), data.alias("d")).filter(F.size("d") >= 2)
    rows = src.select("id", "worksheet", F.split(F.col("d")[0], "\t").alias("headers"), F.posexplode(F.slice("d", F.lit(2), F.size("d"))).alias("row_no", "line"))
    return rows.select("id", "worksheet", "headers", "row_no", F.split("line", "\t").alias("cells"))


def column_of(headers: Column, part: str) -> Column:
    """Position from 0 of the first header that holds a text, whatever its case; null if none does."""
    p = F.array_position(F.transform(headers, lambda h: F.lower(h).contains(part)), True)
    return F.when(p > 0, (p - 1).cast("int"))


def sheet_rows(pages: DataFrame, marks: tuple[str, ...] = ("gtype", "catalogue")) -> DataFrame:
    """Items of item-list and catalogue pages in one schema, with the other cells as ``extra`` (key, value) in order.

    marks: header words that all must be there for an item list.
    """
    g = grid(pages)
    listed = F.lit(True)
    for m in marks:
        listed = listed & column_of(F.col("headers"), m).isNotNull()
    catalogue = ~listed & column_of(F.col("headers"), "itemcode").isNotNull() & column_of(F.col("headers"), "material").isNotNull()

    def cells(words: dict[str, str]) -> dict[str, Column]:
        return {k: F.coalesce(trimmed(F.get("cells", column_of(F.col("headers"), w))), F.lit("")) for k, w in words.items()}

    def extra(words: dict[str, str]) -> Column:
        used = F.array_compact(F.array(*[column_of(F.col("headers"), w) for w in words.values()]))
        pairs = F.zip_with(F.zip_with("headers", F.slice("cells", F.lit(1), F.size("headers")), lambda h, c: F.struct(h.alias("key"), c.alias("value"))), F.sequence(F.lit(0), F.size("headers") - 1), lambda s, i: F.struct(s["key"].alias("key"), s["value"].alias("value"), i.alias("i")))
        kept = F.filter(pairs, lambda s: ~F.array_contains(used, s["i"]) & s["value"].isNotNull() & (trimmed(s["value"]) != ""))
        return F.transform(kept, lambda s: F.struct(s["key"].alias("key"), trimmed(s["value"]).alias("value")))

    a, b = cells(ITEM_LIST), cells(CATALOGUE)
    items = g.filter(listed).select("id", "row_no", *[a[k].alias(k) for k in ITEM_LIST], extra(ITEM_LIST).alias("extra")).filter("type <> ''")
    other = g.filter(catalogue).select(
        "id", "row_no", F.coalesce(or_null(b["code"]), b["sizes"]).alias("reference"), F.lit("").alias("spec_code"), F.coalesce("worksheet", F.lit("UNKNOWN")).alias("type"), b["catalogue_ref"].alias("catalogue_ref"), b["description"].alias("description"),
        b["material"].alias("material"), F.coalesce(or_null(b["size_p1"]), b["sizes"]).alias("size_p1"), F.lit("").alias("size_p2"), F.lit("").alias("size_p3"), extra(CATALOGUE).alias("extra"),
    ).filter("reference <> ''")
    return items.unionByName(other)


def numbered(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, text) with the page's heading, ready to be joined in page order by the caller's slice."""
    return pages.select("document_id", "page_number", "id", F.concat(F.lit("=== Page "), "page_number", F.lit(" ===\n"), F.coalesce("page_text", F.lit(""))).alias("text"))


def located_sheets(results: DataFrame) -> DataFrame:
    """(owner_id, sheet_pos, document_id, first, last) of ``locate.sheets``; ranges that are no numbers are left out."""
    v = results.select(F.col("id").cast("string").alias("owner_id"), "document_id", shred.parse(F.col("raw_json")).alias("v"))
    s = v.select("owner_id", "document_id", F.posexplode(shred.elements(shred.at(F.col("v"), "locate.sheets"))).alias("sheet_pos", "s"))
    page = lambda k: F.try_variant_get("s", f"$.pages.{k}", "int")
    return s.select("owner_id", "document_id", F.col("sheet_pos").cast("int").alias("sheet_pos"), page("start").alias("first"), page("end").alias("last")).filter("first <= last")


def sheet_pages(results: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per located sheet and existing page in its range; where no sheet is located, one sheet per page."""
    have = pages.filter("document_id is not null and page_number is not null").select("document_id", "page_number").distinct()
    sheets = located_sheets(results)
    on = (sheets["document_id"] == have["document_id"]) & F.col("page_number").between(F.col("first"), F.col("last"))
    located = sheets.join(have, on).select("owner_id", "sheet_pos", sheets["document_id"].alias("document_id"), "page_number")
    bare = results.select(F.col("id").cast("string").alias("owner_id"), "document_id").join(sheets.select("owner_id").distinct(), "owner_id", "left_anti").join(have, "document_id")
    return located.unionByName(bare.select("owner_id", (F.col("page_number") - 1).cast("int").alias("sheet_pos"), "document_id", "page_number"))


def joined(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pages, text): numbered pages of a group in page order with a blank line between them; null keys are left out.

    A group is one document or sheet, so its text is one value as it is for every reader of it.
    """
    n = numbered(pages) if "text" not in pages.columns else pages
    some = n.filter(" and ".join(f"{k} is not null" for k in keys))
    parts = F.array_sort(F.collect_list(F.struct("page_number", "id", "text")))
    return some.groupBy(*keys).agg(F.count("*").alias("pages"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def sliced(results: DataFrame, pages: DataFrame) -> DataFrame:
    """(owner_id, sheet_pos, pages, text) of every located sheet's inclusive page range; ranges without pages have none."""
    s, p = located_sheets(results), numbered(pages)
    on = (s["document_id"] == p["document_id"]) & F.col("page_number").between(F.col("first"), F.col("last"))
    return joined(s.join(p, on).select("owner_id", "sheet_pos", "page_number", "id", "text"), ["owner_id", "sheet_pos"])
