"""Quality of isometrics and classes: valves of both sides by class, flags on spools, dimensions and welds, container fit, class tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as K
from ..functions import sizes as S
from ..functions import text as T
from . import crosscheck as X
from .spools import BOUND, BRANCH, PASS_THROUGH, REDUCING_ITEM, clustered_sum, orientation

# Order of statuses; weld tags that a dimension's end names; containers in mm in the order they are tried; notes of rows.
STATUSES = ("pid only", "iso only", "count mismatch", "match")
END_WELD = r"(?i)\b[SF]W\s*0*\d+\b"
CONTAINERS = (("20ft", (5900, 2390, 2350)), ("40ft", (12032, 2390, 2350)))
NOTE = r"(?i)notes?[\s-]*([a-z])\b"
# End of fixed values.


def _side(df: DataFrame, keys: list[str], kind: Column, spec: Column, detail: Column, name: str) -> DataFrame:
    """Counts and details of one side; details are made distinct before they are gathered, in the order of their first id."""
    v = df.select(*keys, F.coalesce(T.class_stem(spec), F.lit("unassigned")).alias("spec_class"), kind.alias("category"), S.dn(F.col("size")).alias("dn"), F.coalesce(T.number(F.col("quantity")), F.lit(1.0)).alias("q"), detail.alias("d"), "id")
    g = [*keys, "spec_class", "category", "dn"]
    one = v.filter("category is not null").groupBy(*g, "d").agg(F.sum("q").alias("q"), F.min("id").alias("id"))
    told = F.transform(F.array_sort(F.collect_list(F.when(F.col("d") != "", F.struct("id", "d")))), lambda s: s["d"])
    return one.groupBy(*g).agg(F.sum("q").alias(f"{name}_count"), told.alias(f"{name}_list"))


def valve_match(bom: DataFrame, pid: DataFrame, keys: list[str]) -> DataFrame:
    """Valves of bills and diagrams by class, kind and size: counts, details, status, totals of the class, place in it.

    bom: keys, id, component_type, description, item_spec_class, size, quantity. pid: keys, id, valve_type, spec_class, size,
    quantity, tag_number. A side without a class is "unassigned"; a missing quantity is one; null sizes are one size. ``place``
    orders the rows of a class by status (only one side first), kind and size; ``class_place`` the classes, the unassigned last.
    """
    text = F.concat(F.coalesce("component_type", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    a = _side(bom, keys, K.valve(text), F.col("item_spec_class"), T.trimmed(F.split(F.coalesce("description", F.lit("")), ",")[0]), "iso")
    tag = T.trimmed(F.coalesce("tag_number", F.lit("")))
    b = _side(pid, keys, K.valve(F.col("valve_type")), F.col("spec_class"), F.when(tag == "", "untagged").otherwise(tag), "pid")
    g = [*keys, "spec_class", "category", "dn"]
    on = reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in g])
    j = a.join(b, on, "full").select(*[F.coalesce(a[c], b[c]).alias(c) for c in g], F.coalesce("iso_count", F.lit(0.0)).alias("iso_count"), F.coalesce("pid_count", F.lit(0.0)).alias("pid_count"), "iso_list", "pid_list")
    i, p = F.col("iso_count"), F.col("pid_count")
    status = F.when((i > 0) & (p == 0), "iso only").when((p > 0) & (i == 0), "pid only").when(i == p, "match").otherwise("count mismatch")
    tags = F.filter("pid_list", lambda d: d != "untagged")
    j = j.withColumn("status", status).withColumn("iso_detail", F.array_join("iso_list", " / ")).withColumn("pid_detail", F.when(F.col("pid_list").isNotNull(), F.coalesce(T.or_null(F.array_join(tags, " / ")), F.lit("untagged"))))
    inside = Window.partitionBy(*keys, "spec_class")
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    classes = Window.partitionBy(*keys).orderBy(F.col("spec_class") == "unassigned", "spec_class")
    return j.select(
        *g, "iso_count", "pid_count", "iso_detail", "pid_detail", "status", F.sum("iso_count").over(inside).alias("iso_total"), F.sum("pid_count").over(inside).alias("pid_total"),
        F.row_number().over(inside.orderBy(rank, "category", F.col("dn").asc_nulls_last())).alias("place"), F.dense_rank().over(classes).alias("class_place"),
    )


# --- flags -----------------------------------------------------------------------------------------

FLAG = "flag string, a string, b string"


def spool_flags(spools: DataFrame, welds: DataFrame, keys: list[str]) -> DataFrame:
    """(id, flag, a): spools bounded on a branch leg, running through a valve, or ended by several field welds.

    spools: keys, id, spool_no, note. welds: keys, spool_no, weld_type. Spools are told apart as they are written.
    """
    fw = welds.filter((F.lower("weld_type") == "field weld") & (F.col("spool_no") != "")).groupBy(*keys, "spool_no").agg(F.count("*").alias("n"))
    n = F.col("note")
    rows = F.array(
        F.when(n.rlike(BRANCH) & n.rlike(BOUND), F.struct(F.lit("branch boundary").alias("flag"), F.lit(None).cast("string").alias("a"))), F.when(n.rlike(PASS_THROUGH), F.struct(F.lit("through valve").alias("flag"), F.lit(None).cast("string").alias("a"))),
        F.when(F.col("n") > 1, F.struct(F.lit("field welds").alias("flag"), F.col("n").cast("string").alias("a"))),
    )
    return spools.join(fw, [*keys, "spool_no"], "left").select("id", F.inline(F.array_compact(rows)))


def dimension_flags(dims: DataFrame, welds: DataFrame, keys: list[str]) -> DataFrame:
    """(id, tag, weld_spool): dimensions whose first named weld of another spool disagrees with their own spool.

    dims: keys, id, spool_no, from_ref, to_ref. welds: keys, id, tag_number, spool_no; of equal tags the last holds.
    """
    bare = lambda t: F.upper(F.regexp_replace(t, r"\s+", ""))
    w = welds.filter("tag_number <> '' and spool_no <> ''").groupBy(*keys, bare(F.col("tag_number")).alias("tag")).agg(F.max_by("spool_no", "id").alias("weld_spool"))
    found = lambda c: F.coalesce(F.transform(F.regexp_extract_all(c, F.lit(END_WELD), F.lit(0)), bare), F.array().cast("array<string>"))
    d = dims.filter("spool_no <> ''").select(*keys, "id", "spool_no", F.posexplode(F.concat(found("from_ref"), found("to_ref"))).alias("n", "tag"))
    bad = d.join(w, [*keys, "tag"]).filter("weld_spool <> spool_no")
    return bad.groupBy("id").agg(F.min(F.struct("n", "tag", "weld_spool")).alias("x")).select("id", "x.tag", "x.weld_spool")


def weld_list_flags(welds: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(id, size_differs, place_differs): welds that disagree with their weld list row in size text or in shop or field.

    welds: keys, id, weld_list_id, size, weld_type. rows: keys, id, number, nd, type; of equal numbers the last holds.
    """
    last = rows.groupBy(*keys, T.trimmed(F.col("number")).alias("_k")).agg(F.max_by(F.struct("nd", "type"), "id").alias("r"))
    j = welds.filter("weld_list_id <> ''").withColumn("_k", T.trimmed(F.col("weld_list_id"))).join(last, [*keys, "_k"])
    sized = (F.col("r.nd") != "") & (F.col("size") != "") & (T.trimmed(F.col("r.nd")) != T.trimmed(F.col("size")))
    field = lambda c: F.when(c != "", F.lower(c).contains("field"))
    placed = field(F.col("r.type")) != field(F.col("weld_type"))
    out = j.select("id", F.coalesce(sized, F.lit(False)).alias("size_differs"), F.coalesce(placed, F.lit(False)).alias("place_differs"))
    return out.filter("size_differs or place_differs")


def same_size_flags(welds: DataFrame, keys: list[str]) -> DataFrame:
    """(id, item_no, size): welds of a reducing item of which two at least are cited and all that state a size state one.

    welds: keys, id, size, note. Empty sizes state none.
    """
    w = welds.withColumn("item_no", F.regexp_extract("note", REDUCING_ITEM, 1)).filter("item_no <> ''")
    bad = w.groupBy(*keys, "item_no").agg(F.count("*").alias("n"), F.countDistinct(T.or_null(F.col("size"))).alias("sizes"), F.max(T.or_null(F.col("size"))).alias("only")).filter("n >= 2 and sizes = 1")
    return w.join(bad, [*keys, "item_no"]).select("id", "item_no", F.col("only").alias("size"))


# --- container fit ---------------------------------------------------------------------------------


def container_fit(dims: DataFrame, points: DataFrame, keys: list[str], overrides: DataFrame | None = None) -> DataFrame:
    """(keys, spool, e, n, el, summed, container, axes): the envelope of every spool and the first container that holds it.

    dims: keys, id, spool_no, axis, value, from_ref, to_ref, excluded. points: keys, spool_no, e, n, el. overrides: keys, spool_no,
    axis, value, replacing an axis. Spools are told apart by their last number. Each axis is the greater of the spread of two points
    or more and the sum of the dimensions along it, those that share a landmark counted once. Dimensions that are excluded, of no
    axis or not positive do not count. A spool without two points, dimensions or an override has no row; an override alone makes none.
    """
    spool = T.trailing_number(F.col("spool_no")).alias("spool")
    axis = F.lower(T.trimmed(F.col("axis")))
    d = dims.filter(~F.coalesce("excluded", F.lit(False)) & (T.trimmed(F.col("spool_no")) != "")).select(*keys, spool, axis.alias("axis"), "id", F.col("value").try_cast("double").alias("value"), "from_ref", "to_ref").filter("axis in ('e', 'n', 'el') and value > 0 and value < double('Infinity')")
    sums = clustered_sum(d, [*keys, "spool", "axis"], "id", "value", ["from_ref", "to_ref"])
    wide = sums.groupBy(*keys, "spool").agg(*[F.max(F.when(F.col("axis") == a, F.col("total"))).alias(f"d_{a}") for a in ("e", "n", "el")], F.max("total").alias("summed"))
    spread = lambda a: F.when(F.count("*") >= 2, F.max(a) - F.min(a)).otherwise(0.0).alias(f"p_{a}")
    p = points.filter("spool_no <> ''").groupBy(*keys, spool).agg(F.count("*").alias("points"), *[spread(a) for a in ("e", "n", "el")])
    j = wide.join(p, [*keys, "spool"], "full")
    if overrides is not None:
        o = overrides.groupBy(*keys, spool).agg(*[F.max(F.when(axis == a, F.col("value"))).alias(f"o_{a}") for a in ("e", "n", "el")], F.lit(True).alias("overridden"))
        j = j.join(o, [*keys, "spool"], "left")
    else:
        j = j.select("*", *[F.lit(None).cast("double").alias(f"o_{a}") for a in ("e", "n", "el")], F.lit(None).cast("boolean").alias("overridden"))
    j = j.filter((F.coalesce("points", F.lit(0)) >= 2) | F.col("summed").isNotNull() | F.coalesce("overridden", F.lit(False)))
    box = [F.coalesce(f"o_{a}", F.greatest(F.coalesce(f"d_{a}", F.lit(0.0)), F.coalesce(f"p_{a}", F.lit(0.0)))).alias(a) for a in ("e", "n", "el")]
    j = j.select(*keys, "spool", *box, "summed")
    b = F.sort_array(F.array("e", "n", "el"), asc=False)
    fits = lambda c: (b[0] <= c[0]) & (b[1] <= c[1]) & (b[2] <= c[2])
    turned = lambda c: orientation(F.array("e", "n", "el"), c)["axes"]
    name, axes = F, F
    for n, c in CONTAINERS:
        name, axes = name.when(fits(c), n), axes.when(fits(c), turned(c))
    return j.withColumn("container", name.otherwise("oversized")).withColumn("axes", axes)


# --- class tables ----------------------------------------------------------------------------------


def mended_rows(classes: DataFrame) -> DataFrame:
    """(class_code, category, pos, label, rating, group, size_min, size_max, lo, hi, repaired, material): rows of the classes with
    ranges that ran backwards mended, and the group of types in which sizes may not overlap."""
    parts = [classes.select("class_code", F.lit(c).alias("category"), F.inline(c)) for c in X.CATEGORIES]
    rows = reduce(DataFrame.unionByName, parts).withColumn("m", S.mended_range(F.col("size_min"), F.col("size_max")))
    group = F.when(F.col("category") == "flanges", F.concat("label", F.lit("|"), "rating")).when(F.col("category") == "pipes", "").otherwise(F.col("label"))
    return rows.select("class_code", "category", "pos", "label", "rating", group.alias("group"), "m.size_min", "m.size_max", S.nps(F.col("m.size_min")).alias("lo"), S.nps(F.col("m.size_max")).alias("hi"), "m.repaired", F.coalesce("description", "material").alias("material"))


def sorted_rows(rows: DataFrame) -> DataFrame:
    """Adds ``place``: groups in the order of their first row, rows of a group by size, those without one last."""
    first = F.min("pos").over(Window.partitionBy("class_code", "category", "group"))
    order = Window.partitionBy("class_code", "category").orderBy("_first", F.col("lo").asc_nulls_last(), "pos")
    return rows.withColumn("_first", first).withColumn("place", F.row_number().over(order)).drop("_first")


def overlapping(rows: DataFrame) -> DataFrame:
    """(class_code, category, group, pos, before, issue): rows that begin at or below the end of the last row with a range in
    their group; valves may overlap."""
    span = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.struct("hi", "pos", row_label().alias("label")))
    w = Window.partitionBy("class_code", "category", "group").orderBy(F.col("lo").asc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.filter("category <> 'valves'").withColumn("_b", F.last(span, ignorenulls=True).over(w))
    bad = seen.filter(F.col("hi").isNotNull() & (F.col("lo") <= F.col("_b.hi") + 1e-9))
    return bad.select("class_code", "category", "group", "pos", F.col("_b.pos").alias("before"), F.concat("_b.label", F.lit(" overlaps "), row_label()).alias("issue"))


def row_label() -> Column:
    """Type, size range and material of a row in one line."""
    q = lambda c: F.coalesce(c, F.lit("?"))
    size = F.when(F.col("size_min").eqNullSafe(F.col("size_max")), q("size_min")).otherwise(F.concat(q("size_min"), F.lit("-"), q("size_max")))
    kind = F.when(F.col("category") == "pipes", "Pipe").when(F.col("group") == "", F.col("category")).otherwise(F.col("group"))
    text = T.trimmed(F.coalesce("material", F.lit("")))
    return F.concat(kind, F.lit(" "), size, F.when(text != "", F.concat(F.lit(" ("), text, F.lit(")"))).otherwise(""))


def note_issues(rows: DataFrame, legend: DataFrame) -> DataFrame:
    """(class_code, letter, issue): notes that rows cite and the class's legend lacks, and legend entries that no row cites.

    rows: class_code, notes. legend: class_code, letter. Letters are compared whatever their case; blanks do not count.
    """
    cited = rows.select("class_code", F.explode(F.regexp_extract_all("notes", F.lit(NOTE), F.lit(1))).alias("letter")).select("class_code", F.lower("letter").alias("letter")).distinct()
    known = legend.select("class_code", F.lower(T.trimmed(F.col("letter"))).alias("letter")).filter("letter <> ''").distinct()
    k = ["class_code", "letter"]
    return cited.join(known, k, "left_anti").withColumn("issue", F.lit("not in the legend")).unionByName(known.join(cited, k, "left_anti").withColumn("issue", F.lit("not cited")))
