"""Staged findings of isometrics against the other documents of their project.

Every stage is one DataFrame of findings over the lines or items of all isometrics. A stage that
stops an isometric is an aggregate over its lines: one small row per document comes back to them.
The first row of a list holds (by tag id), as the stages are defined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compare as C
from ..functions import text as T
from . import shred

# Title fields; fields compared as (code, field of the isometric, field of the list, as number, severity); support types.
TITLE = ("document_number", "drawing_number", "revision", "sheet", "spec_class", "size")
COMPARED = (
    ("1.size", "size", "size", True, "error"),
    ("2.design_pressure", "design_pressure", "design_pressure", True, "error"),
    ("2.design_temperature", "design_temperature", "design_temperature", True, "error"),
    ("2.operating_pressure", "operating_pressure", "operating_pressure", True, "warning"),
    ("2.operating_temperature", "operating_temperature", "operating_temperature", True, "warning"),
    ("2.test_pressure", "hydrotest_pressure", "test_pressure", True, "error"),
    ("2.service", "service", "service", False, "warning"),
    ("2.paint_system", "painting_system", "paint_system", False, "warning"),
    ("2.insulation_thickness", "insul_thickness_mm", "insulation_thickness", True, "warning"),
    ("2.insulation_code", "insul_spec", "insulation_code", False, "warning"),
    ("2.pwht", "pwht", "pwht", False, "warning"),
    ("2.ndt_percent", "radiograph", "ndt_percent", True, "warning"),
    ("2.heat_trace", "heat_trace", "heat_trace", False, "warning"),
    ("2.slope", "slope", "slope", False, "warning"),
)
#: Rows of the design basis: (label, field of the isometric, field of the list, as number).
BASIS = (
    ("Piping class", "spec_class", "spec_class", False), ("Size", "size", "size", True), ("Design pressure", "design_pressure", "design_pressure", True), ("Design temperature", "design_temperature", "design_temperature", True),
    ("Operating pressure", "operating_pressure", "operating_pressure", True), ("Operating temperature", "operating_temperature", "operating_temperature", True), ("Test pressure", "hydrotest_pressure", "test_pressure", True),
    ("Service", "service", "service", False), ("Insulation code", "insul_spec", "insulation_code", False), ("Insulation thickness", "insul_thickness_mm", "insulation_thickness", True), ("Heat trace", "heat_trace", "heat_trace", False),
    ("Paint system", "painting_system", "paint_system", False), ("NDT / radiograph", "radiograph", "ndt_percent", True), ("Slope", "slope", "slope", False),
)
SUPPORT_TYPE = r"[A-Z]{1,3}\d{2,}"
CONTINUED = r"(?i)\bCONT\b|\bCONT'?D\b|\bCONTINUE|\bDRG\b|\bDWG\b"
# End of fixed values.
ISO_FIELDS = sorted({*TITLE, *(c[1] for c in COMPARED), *(b[1] for b in BASIS)})
LIST_FIELDS = sorted({"spec_class", *(c[2] for c in COMPARED), *(b[2] for b in BASIS)})
FINDING = ["document_id", "tag_id", "field_checked", "severity", "value_a", "value_b"]


def bags(tags: DataFrame, where: Column, fields: list[str]) -> DataFrame:
    """(tag_id, project_id, document_id, number, k, a) of the tags of one kind; a holds the named fields as texts."""
    t = tags.filter(where)
    return t.select(F.col("id").alias("tag_id"), "project_id", "document_id", F.col("tag_number").alias("number"), T.tag_key(F.col("tag_number")).alias("k"), F.from_json("attributes", ", ".join(f"{f} string" for f in fields)).alias("a"))


def iso_lines(tags: DataFrame) -> DataFrame:
    """Lines of the isometrics with blanks of the title block filled from the line number, and their class breaks."""
    kind = (F.col("tag_type") == "line") & (F.col("doc_type") == "iso")
    b = bags(tags.withColumn("_v", shred.parse(F.col("attributes"))), kind, ISO_FIELDS)
    done = T.completed_line(F.col("number"), {f: F.col(f"a.{f}") for f in ("size", "service", "spec_class", "heat_trace", "insul_spec")})
    lines = b.select("tag_id", "project_id", "document_id", "number", "k", *[done.get(f, F.col(f"a.{f}")).alias(f) for f in ISO_FIELDS])
    v = tags.filter(kind).select(F.col("id").alias("tag_id"), F.try_variant_get(shred.parse(F.col("attributes")), "$.spec_breaks", "array<variant>").alias("_b"))
    get = lambda x, c: F.try_variant_get(x, f"$.{c}", "string")
    breaks = F.transform("_b", lambda x: F.struct(get(x, "spec_class").alias("spec_class"), get(x, "rating").alias("rating")))
    return lines.join(v.select("tag_id", F.coalesce(breaks, F.array().cast("array<struct<spec_class:string,rating:string>>")).alias("breaks")), "tag_id")


def listed(tags: DataFrame, last: bool = False) -> DataFrame:
    """(project_id, k, n, and the list's fields): the first (or last) row of each line with the number of its rows."""
    p = bags(tags, (F.col("tag_type") == "line") & (F.col("doc_type") == "pll"), LIST_FIELDS)
    choose = F.max_by if last else F.min_by
    return p.groupBy("project_id", "k").agg(F.count("*").alias("n"), choose(F.struct(*[F.col(f"a.{f}").alias(f) for f in LIST_FIELDS]), "tag_id").alias("l"))


def _found(df: DataFrame, *rows: tuple[str, str, Column, Column, Column]) -> DataFrame:
    """Findings (code, severity, condition, value_a, value_b) of each row of ``df``, all in one pass."""
    each = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("field_checked"), F.lit(sev).alias("severity"), a.cast("string").alias("value_a"), b.cast("string").alias("value_b"))) for code, sev, c, a, b in rows]
    return df.select("document_id", "tag_id", F.inline(F.array_compact(F.array(*each))))


def compared(joined: DataFrame, fields, keep: list[str]) -> DataFrame:
    """``keep``, name, value_a, value_b, status of every field pair of a line and its list row ``l``."""
    rows = [F.struct(F.lit(f[0]).alias("name"), F.lit(f[3]).alias("numeric"), F.col(f[1]).alias("value_a"), F.col(f"l.{f[2]}").alias("value_b")) for f in fields]
    stacked = C.prepared(joined.select(*keep, F.inline(F.array(*rows))), "value_a", "value_b")
    return stacked.select(*keep, "name", "value_a", "value_b", F.when(F.col("numeric"), C.verdict(True)).otherwise(C.verdict(False)).alias("status"))


def design_basis(tags: DataFrame) -> DataFrame:
    """(tag_id, field, iso_value, pll_value, status) of every line and each of the fourteen rows; of several list rows the last holds."""
    j = iso_lines(tags).join(listed(tags, last=True), ["project_id", "k"])
    return compared(j, BASIS, ["tag_id"]).select("tag_id", F.col("name").alias("field"), F.col("value_a").alias("iso_value"), F.col("value_b").alias("pll_value"), "status")


def findings(tags: DataFrame) -> DataFrame:
    """FINDING rows of all isometrics: title block, list, line fields, diagrams, classes and breaks, supports, arrangements.

    A project without line lists gives one note per isometric instead of stages 1 and 2, and stops nothing. A line missing
    from the list stops all later stages of its isometric, a class that differs all after it. Null line numbers are in no list.
    """
    null = F.lit(None).cast("string")
    lines = iso_lines(tags)
    kinds = tags.groupBy("project_id").agg(*[F.max((F.col("doc_type") == d).cast("int")).alias(f"has_{d}") for d in ("pll", "pid", "ga", "spec_sheet")])
    other = tags.filter("tag_type = 'line' and doc_type in ('pid', 'ga')").groupBy("project_id", T.tag_key(F.col("tag_number")).alias("k")).agg(F.max((F.col("doc_type") == "pid").cast("int")).alias("on_pid"), F.max((F.col("doc_type") == "ga").cast("int")).alias("on_ga"))
    known = tags.filter("tag_type = 'spec_class'").select("project_id", T.tag_key(F.col("tag_number")).alias("c")).distinct()
    classes = known.groupBy("project_id").agg(F.collect_set("c").alias("classes"))  # a project's class codes: a few dozen
    first = lines.groupBy("document_id").agg(F.min("tag_id").alias("first_id"))
    j = lines.join(listed(tags), ["project_id", "k"], "left").join(kinds, "project_id", "left").join(other, ["project_id", "k"], "left").join(classes, "project_id", "left").join(first, "document_id")
    blank, key = T.blank, T.tag_key
    cls, theirs = F.col("spec_class"), F.col("l.spec_class")
    has = lambda d: F.coalesce(F.col(f"has_{d}") == 1, F.lit(False))
    missing = has("pll") & F.col("n").isNull()
    clash = has("pll") & F.col("n").isNotNull() & ~blank(cls) & ~blank(theirs) & (key(cls) != key(theirs))
    stops = j.groupBy("document_id").agg(F.max(missing).alias("stop1"), F.max(F.coalesce(clash, F.lit(False))).alias("stop2"))
    j = j.join(stops, "document_id").withColumn("go2", ~F.col("stop1")).withColumn("go3", ~F.col("stop1") & ~F.col("stop2")).withColumn("clash", F.coalesce(clash, F.lit(False)))
    parts = T.line_parts(F.col("number"))
    size = T.number(F.col("size"))
    letters = lambda v: F.regexp_replace(key(F.coalesce(v, F.lit(""))), '[^A-Z0-9"]', "")
    absent = lambda f: parts.isNull() & ~blank(F.col(f)) & ~letters(F.col("number")).contains(letters(F.col(f)))
    on_list = has("pll") & F.col("n").isNotNull()
    in_classes = lambda c: F.coalesce(F.array_contains("classes", key(c)), F.lit(False))
    titles = [(f"0.{f}", "warning", blank(F.col(f)), null, null) for f in TITLE]
    base = _found(
        j, *titles,
        ("1.line_exists", "info", ~has("pll") & (F.col("tag_id") == F.col("first_id")), null, null), ("1.line_exists", "error", missing, F.col("number"), null),
        ("1.duplicates", "warning", on_list & (F.col("n") > 1), F.col("number"), F.col("n")),
        ("1.decode_size", "warning", on_list & parts.isNotNull() & size.isNotNull() & (size != parts["size_mm"]), F.col("size"), parts["size"]),
        ("1.decode_class", "warning", on_list & parts.isNotNull() & ~blank(cls) & (key(cls) != key(parts["spec_class"])), cls, parts["spec_class"]),
        ("1.decode_size", "warning", on_list & absent("size"), F.col("size"), F.col("number")), ("1.decode_class", "warning", on_list & absent("spec_class"), cls, F.col("number")),
        ("2.piping_class", "error", F.col("go2") & F.col("clash"), cls, theirs),
        ("3.line_on_pid", "error", F.col("go3") & has("pid") & (F.coalesce("on_pid", F.lit(0)) == 0), F.col("number"), null),
        ("4.spec_class", "error", F.col("go3") & has("spec_sheet") & cls.isNotNull() & (cls != "") & ~in_classes(cls), cls, null),
        ("8.line_routing", "warning", F.col("go3") & has("ga") & (F.coalesce("on_ga", F.lit(0)) == 0), F.col("number"), null),
    )
    fields = compared(j.filter(on_list), COMPARED, ["document_id", "tag_id", "go2", "clash"]).filter("status = 'mismatch' and (name like '1.%' or (go2 and not clash))")
    severity = F.create_map(*[F.lit(x) for c in COMPARED for x in (c[0], c[4])])
    by_field = fields.select("document_id", "tag_id", F.col("name").alias("field_checked"), severity[F.col("name")].alias("severity"), "value_a", "value_b")
    broken = j.filter(F.col("go3") & has("spec_sheet") & cls.isNotNull() & (cls != "") & (F.size("breaks") > 1))
    each = broken.select("document_id", "tag_id", "classes", cls.alias("own"), F.explode("breaks").alias("b")).filter(~blank(F.col("b.spec_class")))
    by_break = each.filter((key(F.col("b.spec_class")) != key(F.col("own"))) & ~in_classes(F.col("b.spec_class"))).select("document_id", "tag_id", F.lit("4.break_spec_class").alias("field_checked"), F.lit("error").alias("severity"), F.col("b.spec_class").alias("value_a"), null.alias("value_b"))
    items = bags(tags, (F.col("tag_type") == "bom_item") & (F.col("doc_type") == "iso"), ["component_type", "description", "line_number", "item_code"])
    # Ratings of the parts at a break: the best of the line's flanges and gaskets against the higher class.
    text = F.concat(F.coalesce("a.component_type", F.lit("")), F.lit(" "), F.coalesce("a.description", F.lit("")))
    rated = items.select("document_id", key(F.col("a.line_number")).alias("k"), F.lower(text).alias("t"), T.rating(F.concat(F.coalesce("a.description", F.lit("")), F.lit(" "), F.coalesce("a.item_code", F.lit("")))).alias("r"))
    best = rated.groupBy("document_id", "k").agg(*[F.max(F.when(F.col("t").contains(w), F.col("r"))).alias(w) for w in ("flange", "gasket")])
    ratings = F.filter(F.transform("breaks", lambda b: b["rating"].try_cast("double")), lambda r: r.isNotNull())
    need = j.filter(F.col("go3") & has("spec_sheet") & (F.size("breaks") > 1)).withColumn("rs", ratings).filter((F.size("rs") > 1) & (F.array_max("rs") != F.array_min("rs"))).withColumn("need", F.array_max("rs"))
    need = need.join(best, ["document_id", "k"], "left")
    sharp = lambda c: F.concat(c.cast("int").cast("string"), F.lit("#"))
    by_rating = _found(need, *[(f"4.break_{w}_rating", "error", F.col(w) < F.col("need"), sharp(F.col(w)), sharp(F.col("need"))) for w in ("flange", "gasket")])
    stop = j.groupBy("document_id").agg(F.min("go3").alias("go3"))
    supports = items.filter(F.lower("a.component_type").contains("support")).join(stop.filter("go3"), "document_id")
    by_support = _found(supports, ("6.support_type", "warning", ~F.coalesce("a.description", F.lit("")).rlike(SUPPORT_TYPE), F.coalesce("a.description", F.lit("")), null))
    return reduce(DataFrame.unionByName, [x.select(*FINDING) for x in (base, by_field, by_break, by_rating, by_support)])


# --- single comparisons of the diagram stage -------------------------------------------------------


def line_without_classes(number: Column, classes: Column) -> Column:
    """Line key with the codes of its classes taken out, so that both sides of a class break agree."""
    bare = F.aggregate(F.coalesce(classes, F.array().cast("array<string>")), T.tag_key(number), lambda acc, c: F.replace(acc, F.upper(c), F.lit("")))
    return F.regexp_replace(bare, "--+", "-")


def same_line(candidate: Column, number: Column, classes: Column) -> Column:
    """Whether two line numbers are one line, in another class where the line has several."""
    given = F.coalesce(T.trimmed(candidate) != "", F.lit(False))
    return given & ((T.tag_key(candidate) == T.tag_key(number)) | ((F.size(F.coalesce(classes, F.array().cast("array<string>"))) > 1) & (line_without_classes(candidate, classes) == line_without_classes(number, classes))))


def drawing_classes(own: Column, breaks: Column) -> Column:
    """Distinct classes of a drawing in the order they are first seen: the title block's, then those of its breaks."""
    all_ = F.concat(F.array(own), F.transform(breaks, lambda b: b["spec_class"]))
    return F.array_distinct(F.transform(F.filter(all_, lambda c: ~T.blank(c)), lambda c: F.upper(T.trimmed(c))))


def covered(expected: Column, found: Column) -> Column:
    """Whether any found reference holds the expected one or is held by it."""
    e = T.tag_key(expected)
    return F.exists(found, lambda r: (r != "") & (r.contains(e) | e.contains(r)))


def continuation(v: Column) -> Column:
    """Whether a route's end refers to another drawing."""
    return ~T.blank(v) & v.rlike(CONTINUED)


def at_endpoint(value: Column, ends: Column) -> Column:
    """Whether a route's end corresponds to one of the diagram's, by containment either way; blanks always do."""
    v = T.endpoint(value)
    return T.blank(value) | (v == "") | F.exists(ends, lambda e: (e != "") & (e.contains(v) | v.contains(e)))


#: Parts that a legend's typical implies, with what the bill must say.
IMPLIED = (("thermowell", r"thermo\s*well", r"thermo\s*well|\btw\b"), ("orifice plate/flanges", r"orifice", r"orifice"), ("diaphragm seal", r"diaphragm", r"diaphragm"))
# End of fixed values.


def implied_missing(implied: Column, bill: Column, valves: Column) -> Column:
    """Labels of implied parts that the bill's text lacks; isolation valves are missing only where it has no valve at all."""
    i, b = F.lower(implied), F.lower(F.coalesce(bill, F.lit("")))
    rows = [F.when(i.rlike(need) & ~b.rlike(have), label) for label, need, have in IMPLIED]
    return F.array_compact(F.array(*rows, F.when(i.contains("isolation valve") & (valves == 0), "isolation valve(s)")))
