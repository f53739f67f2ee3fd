"""Extraction output to tags: one row per thing found, with the number it is known by and its attributes.

All arrays of a sheet come from one pass over the parsed text; numbers that a sheet does not print
are made from its page and the position in the array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import shred

# Arrays of an ISO sheet as (array, tag type, field of the number, prefix of made numbers, fields).
ISO_ARRAYS = (
    ("bom_items", "bom_item", "item_no", None, ("description", "component_type", "size", "quantity", "material", "item_code", "item_spec_class", "item_spec_basis")),
    ("spools", "spool", "spool_no", None, ("boundary_note",)),
    ("welds", "weld", "weld_tag", "W", ("spool_no", "weld_type", "size", "weld_list_id", "location_note")),
    ("weld_list", "weld_list_row", "id", "WLR", ("nd", "type", "category")),
    ("route_points", "route_point", None, "RP", ("spool_no", "easting_mm", "northing_mm", "elevation_mm", "location_note")),
    ("dimensions", "dimension", None, "DIM", ("spool_no", "value_mm", "axis", "from_ref", "to_ref")),
    ("cut_pieces", "cut_piece", "piece_no", "CUT", ("spool_no", "cut_length_mm", "size", "remarks", "end1", "end2", "from_ref", "to_ref")),
)
LINE_FIELDS = (
    "drawing_number", "document_number", "size", "spec_class", "service", "from_location", "to_location", "slope", "scale", "sheet", "revision", "owner_pid_no", "pid_no", "owner_ga_dwg_no", "ga_dwg_no", "design_pressure", "design_temperature",
    "operating_pressure", "operating_temperature", "hydrotest_pressure", "hydrotest_temperature", "painting_system", "radiograph", "test_type", "insul_spec", "insul_thickness_mm",
)
#: Things of diagrams and lists by the field that names their kind: (field, tag type, fields of the number).
THINGS = (
    ("valve_type", "valve", ("tag_number", "valve_type")), ("fitting_type", "fitting", ("fitting_type",)), ("instrument_type", "instrument", ("tag_number", "instrument_type")), ("equipment_type", "equipment", ("tag_number", "equipment_type")),
    ("support_type", "support", ("support_tag",)), ("symbol", "legend_item", ("symbol",)), ("phase", "stream", ("stream_number", "line_number")),
)
# End of fixed values.
TAG = ["result_id", "document_id", "sheet_pos", "pos", "page", "tag_type", "tag_number", "tag_key", "attributes"]


def _sheets(results: DataFrame) -> DataFrame:
    v = results.select(F.col("id").alias("result_id"), "document_id", shred.parse(F.col("raw_json")).alias("v"))
    return v.select("result_id", "document_id", F.posexplode(shred.elements(shred.at(F.col("v"), "sheets"))).alias("sheet_pos", "s"))


def _bag(x: Column, fields: tuple[str, ...], more: dict[str, Column] = {}) -> Column:  # noqa: B006
    """Stated fields as a map; cells of several lines are joined."""
    get = {f: T.cell(F.try_variant_get(x, f"$.{f}", "string")) for f in fields} | more
    full = F.map_from_arrays(F.array(*[F.lit(k) for k in get]), F.array(*get.values()))
    return F.map_filter(full, lambda _, value: value.isNotNull())


def rated_breaks(r: Column) -> Column:
    """array<struct<spec_class, rating>> of a sheet's class breaks; a rating that is none of the known ones counts by its digits."""
    get = lambda x, c: F.try_variant_get(x, f"$.{c}", "string")
    digits = lambda x: F.nullif(F.regexp_replace(get(x, "rating"), r"\D", "").try_cast("int"), F.lit(0))
    return F.transform(F.coalesce(shred.elements(shred.at(r, "spec_breaks")), F.array()), lambda x: F.struct(get(x, "spec_class").alias("spec_class"), F.coalesce(T.rating(get(x, "rating")), digits(x)).alias("rating")))


def iso_tags(results: DataFrame) -> DataFrame:
    """TAG rows of every ISO sheet: its line and the elements of its seven arrays.

    Elements that are no objects give no tag but keep their place in made numbers; spools and bill items without a number
    give none (spool) or a null one (bill item). Unreadable results and sheets without result have no tags.
    """
    s = _sheets(results)
    r = s.select("result_id", "document_id", F.col("sheet_pos").cast("int").alias("sheet_pos"), F.try_variant_get("s", "$.pageNumber", "int").alias("page"), F.try_variant_get("s", "$.drawing_number", "string").alias("drawing"), shred.at(F.col("s"), "result").alias("r"))
    whole = F.when(shred.is_object(F.col("r")), F.col("r")).otherwise(shred.parse(F.try_variant_get("r", "$", "string")))
    r = r.withColumn("r", whole).filter(shred.is_object(F.col("r"))).withColumn("line", F.try_variant_get("r", "$.line_number", "string")).withColumn("breaks", rated_breaks(F.col("r")))
    number = F.coalesce(T.cell(F.col("line")), F.col("line"))
    text = lambda f: T.cell(F.try_variant_get("r", f"$.{f}", "string"))
    done = T.completed_line(number, {f: text(f) for f in ("size", "service", "spec_class", "insul_spec")})
    title = _bag(F.col("r"), tuple(f for f in LINE_FIELDS if f not in done and f not in ("slope", "drawing_number")), done | {"slope": T.slope(text("slope")), "drawing_number": F.coalesce(text("drawing_number"), F.col("drawing"))})
    lines = r.filter(F.coalesce(F.col("line") != "", F.lit(False))).select("result_id", "document_id", "sheet_pos", F.lit(0).alias("pos"), "page", F.lit("line").alias("tag_type"), number.alias("tag_number"), title.alias("attributes"))
    rows = F.array(*[F.struct(F.lit(t).alias("tag_type"), F.lit(i).alias("kind"), shred.elements(shred.at(F.col("r"), a)).alias("items")) for i, (a, t, _, _, _) in enumerate(ISO_ARRAYS)])
    each = r.select("result_id", "document_id", "sheet_pos", "page", "drawing", "line", "breaks", F.try_variant_get("r", "$.spec_class", "string").alias("class"), F.inline(F.filter(rows, lambda x: F.size(x["items"]) > 0)))
    each = each.select("*", F.posexplode("items").alias("pos", "x")).drop("items").filter(shred.is_object(F.col("x")))
    number, bag = None, None
    for i, (_, kind, field, prefix, fields) in enumerate(ISO_ARRAYS):
        raw = F.try_variant_get("x", f"$.{field}", "string") if field else F.lit(None).cast("string")
        made = F.concat(F.lit(prefix), F.col("page").cast("string"), F.lit("-"), (F.col("pos") + 1).cast("string")) if prefix else None
        n = raw if kind == "bom_item" else T.cell(raw)
        n = F.coalesce(n, made) if made is not None else n
        more = {"line_number": F.col("line"), "drawing_number": F.col("drawing")}
        if kind == "bom_item":
            told = F.concat(F.coalesce(F.try_variant_get("x", "$.description", "string"), F.lit("")), F.lit(" "), F.coalesce(F.try_variant_get("x", "$.item_code", "string"), F.lit("")))
            own, by_rating = T.cell(F.try_variant_get("x", "$.item_spec_class", "string")), T.class_by_rating(told, F.col("breaks"))
            basis = F.coalesce(T.cell(F.try_variant_get("x", "$.item_spec_basis", "string")), F.when(own.isNull() & by_rating.isNotNull(), "rating"))
            more |= {"item_spec_class": F.coalesce(own, by_rating), "item_spec_basis": basis, "spec_class": F.col("class")}
        b = _bag(F.col("x"), tuple(f for f in fields if f not in more), more)
        here = F.col("kind") == i
        number, bag = (F.when(here, n), F.when(here, b)) if number is None else (number.when(here, n), bag.when(here, b))
    found = each.select("result_id", "document_id", "sheet_pos", F.col("pos").cast("int").alias("pos"), "page", "tag_type", number.alias("tag_number"), bag.alias("attributes")).filter("tag_type <> 'spool' or tag_number is not null")
    return lines.unionByName(found).withColumn("tag_key", T.tag_key(F.col("tag_number"))).select(*TAG)


def listed_things(results: DataFrame) -> DataFrame:
    """TAG rows of the ``items`` of diagrams, arrangements and balances; an item's kind is told by the field that names it.

    Without a number of its own a thing is known by its kind. Items that name no kind are left out.
    """
    s = _sheets(results).select("result_id", "document_id", F.col("sheet_pos").cast("int").alias("sheet_pos"), F.try_variant_get("s", "$.pageNumber", "int").alias("page"), F.posexplode(shred.elements(shred.at(F.col("s"), "items"))).alias("pos", "x"))
    m = s.select("result_id", "document_id", "sheet_pos", F.col("pos").cast("int").alias("pos"), "page", F.try_variant_get("x", "$", "map<string,string>").alias("m")).filter("m is not null")
    kind, number = None, None
    for field, tag_type, names in THINGS:
        here = F.map_contains_key("m", field)
        n = F.coalesce(*[T.cell(F.try_element_at("m", F.lit(c))) for c in names], F.lit(tag_type))
        kind, number = (F.when(here, tag_type), F.when(here, n)) if kind is None else (kind.when(here, tag_type), number.when(here, n))
    bag = F.map_filter(F.transform_values("m", lambda _, v: T.cell(v)), lambda _, v: v.isNotNull())
    found = m.select("result_id", "document_id", "sheet_pos", "pos", "page", kind.alias("tag_type"), number.alias("tag_number"), bag.alias("attributes")).filter("tag_type is not null")
    return found.withColumn("tag_key", T.tag_key(F.col("tag_number"))).select(*TAG)


def spec_classes(results: DataFrame) -> DataFrame:
    """(result_id, pos, class_code, detailed, service, pipes, fittings, flanges, valves): the index of classes with the details
    of the same code, and empty arrays where a class has none; details are found by the code in upper case without white space at its ends."""
    v = results.select(F.col("id").alias("result_id"), shred.parse(F.col("raw_json")).alias("v"))
    details = F.transform_keys(F.coalesce(F.try_variant_get("v", "$.detail", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, _: T.tag_key(k))
    c = v.select("result_id", details.alias("d"), F.posexplode(shred.elements(shred.at(F.col("v"), "classes"))).alias("pos", "c"))
    c = c.withColumn("class_code", F.try_variant_get("c", "$.class_code", "string")).withColumn("x", F.try_element_at("d", T.tag_key(F.col("class_code"))))
    arrays = [F.coalesce(shred.elements(shred.at(F.col("x"), a)), F.array().cast("array<variant>")).alias(a) for a in ("pipes", "fittings", "flanges", "valves")]
    return c.select("result_id", F.col("pos").cast("int").alias("pos"), "class_code", F.col("x").isNotNull().alias("detailed"), F.try_variant_get("x", "$.service", "string").alias("service"), *arrays)


#: One function per type of document.
EXTRACTORS = {"iso": iso_tags, "pid": listed_things, "pfd": listed_things, "ga": listed_things, "hmb": listed_things}


def all_tags(results: DataFrame) -> DataFrame:
    """TAG rows of all results, each by the extractor of its schema's document type; types without one have no tags."""
    kind = F.split("schema_version", r"\.")[0]
    same: dict = {}
    for name, f in EXTRACTORS.items():
        same.setdefault(f, []).append(name)
    out = None
    for f, names in same.items():
        part = f(results.filter(kind.isin(*names)))
        out = part if out is None else out.unionByName(part)
    return out
