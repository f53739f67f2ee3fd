"""Items and bill rows against the rows of their piping class: type hints, size ranges, ratings, verdicts.

A class is one row with an array of rows per category, so an item meets its class in one join on
the class code and everything after it is array functions on that row: nothing is exploded and
grouped again. The arrays are as long as the printed tables of one class.

Sizes are compared as DN: the rows of a class are given in DN, and an item's size counts only if
the list of nominal sizes has it. The label of a row is its fitting, flange or valve type, or its
description where it has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sizes as S
from ..functions import text as T
from . import shred

# What an item list's type codes are checked against. (category, hint, not these, branch, size optional, words that give another hint)
CATEGORIES = ("pipes", "fittings", "flanges", "valves")
TYPE_CODES: dict[str, tuple] = {
    "TUBE": ("pipes", "", (), False, False, ()),
    "ELBO": ("fittings", "elbow", (), False, False, ()),
    "TEE": ("fittings", "tee", (), True, False, (("reducing", "reduced"), ("equal", "straight"))),
    "REDU": ("fittings", "reducer", (), False, False, ()),
    "OLET": ("fittings", "olet", (), True, False, ()),
    "CAP": ("fittings", "cap", (), False, False, ()),
    "FLAN": ("flanges", "flange", ("blind", "orifice"), False, False, (("orifice", "orifice"),)),
    "FBLI": ("flanges", "blind", ("spectacle",), False, False, ()),
    "PCOM": ("flanges", "spectacle", (), False, False, (("spade", "spade"), ("spacer", "spade"))),
    "VALV": ("valves", "", (), False, False, tuple((w, w) for w in ("ball", "gate", "globe", "check", "butterfly"))),
    "GASK": ("flanges", "gasket", (), False, False, ()),
    "BOLT": ("flanges", "bolt", (), False, True, ()),
}
OUT_OF_SCOPE = {"ATTA": "supports follow the support standard", "WELD": "a mark for fabrication", "FTUB": "nipples are not listed", "INST": "instruments follow the instrument index", "BEND": "a drafting aid"}
BOM_EXCLUDES = {"blind": ("spectacle",), "flange": ("blind", "orifice")}
FITTING_RATING = "see pipe schedule"
DETAILS = (
    r"(?i)\bSS\s?\d{3}L?\s*(Trim|Ball|Disc|Wedge|Seat(\s*ring)?)?\b", r"(?i)\b13\s?CR\b", r"(?i)\bStellite\s?\d*\b", r"\bHF\b", r"(?i)\bHard[- ]?fac(ed|ing)\b", r"(?i)\bRPTFE(\s*seat)?\b",
    r"(?i)\b(Bolted|Welded|Pressure[- ]?seal)\s*(Bonnet|Cover)\b",
)
# End of fixed values.
HINT = "struct<category:string,hint:string,excludes:array<string>,branch:boolean,optional:boolean>"


def _texts(words) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def item_hint(type_: Column, text: Column) -> Column:
    """What a typed item is checked against; null for codes out of scope. Of several words in its text the earliest decides."""
    rows = []
    for code, (category, hint, excludes, branch, optional, subs) in TYPE_CODES.items():
        words = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(h).alias("hint")) for w, h in subs]).cast("array<struct<word:string,hint:string>>")
        rows += [F.lit(code), F.struct(F.lit(category).alias("category"), F.lit(hint).alias("hint"), _texts(excludes).alias("excludes"), F.lit(branch).alias("branch"), F.lit(optional).alias("optional"), words.alias("subs"))]
    base = F.try_element_at(F.create_map(*rows), type_)
    low = F.lower(text)
    found = F.filter(F.transform(base["subs"], lambda s: F.struct(F.position(s["word"], low).alias("at"), s["hint"].alias("hint"))), lambda s: s["at"] > 0)
    sub = F.array_min(found)["hint"]
    picked = F.struct(base["category"].alias("category"), F.coalesce(sub, base["hint"]).alias("hint"), F.when(sub.isNull(), base["excludes"]).otherwise(_texts(())).alias("excludes"), base["branch"].alias("branch"), base["optional"].alias("optional"))
    return F.when(base.isNotNull(), picked)


def bom_hint(found: Column) -> Column:
    """The same for a classified bill row (struct<category, hint>)."""
    excludes = F.create_map(*[x for k, v in BOM_EXCLUDES.items() for x in (F.lit(k), _texts(v))])
    picked = F.struct(found["category"].alias("category"), found["hint"].alias("hint"), F.coalesce(F.try_element_at(excludes, found["hint"]), _texts(())).alias("excludes"), F.lit(False).alias("branch"), F.lit(False).alias("optional"))
    return F.when(found.isNotNull(), picked)


def known_dn(v: Column) -> Column:
    """DN of a size in mm, null if the list of nominal sizes has none such."""
    d = F.floor(T.trimmed(v).try_cast("double") + 0.5)
    return F.when(S.nps_of_dn(v).isNotNull(), d)


def _row(x: Column, i: Column) -> Column:
    get = lambda c: F.try_variant_get(x, f"$.{c}", "string")
    label = F.coalesce(get("fitting_type"), get("flange_type"), get("valve_type"), get("description"), F.lit(""))
    return F.struct(
        i.alias("pos"), label.alias("label"), get("size_min").alias("size_min"), get("size_max").alias("size_max"), S.nps(get("size_min")).alias("lo"), S.nps(get("size_max")).alias("hi"),
        F.coalesce(T.trimmed(get("class")), F.lit("")).alias("rating"), F.coalesce(T.trimmed(get("end_type")), F.lit("")).alias("end_type"), F.coalesce(T.trimmed(get("schedule")), F.lit("")).alias("schedule"),
        get("description").alias("description"), get("material").alias("material"), shred.is_object(x).alias("real"),
    )


def class_table(tags: DataFrame) -> DataFrame:
    """(class_code, id, pipes, fittings, flanges, valves, branches): of several tags of a class the one with most rows, the first of equals.

    Unreadable attributes give empty arrays; elements that are no objects keep their position and are left out.
    """
    t = tags.filter(F.col("tag_type") == "spec_class").select("id", T.bom_class(F.col("tag_number")).alias("class_code"), shred.parse(F.col("attributes")).alias("v")).filter("class_code is not null")
    cell = lambda x: F.struct(*[F.try_variant_get(x, f"$.{c}", "string").alias(c) for c in ("header_size", "branch_size", "material", "code", "notes")])
    none = lambda a: F.coalesce(a, F.array())
    arrays = [F.filter(F.transform(none(shred.elements(shred.at(F.col("v"), c))), _row), lambda r: r["real"]).alias(c) for c in CATEGORIES]
    arrays.append(F.transform(none(shred.elements(shred.at(F.col("v"), "resolved_branches"))), cell).alias("branches"))
    full = t.select("id", "class_code", *arrays)
    rank = F.struct(sum(F.size(c) for c in CATEGORIES).alias("n"), (-F.col("id")).alias("i"))
    best = full.groupBy("class_code").agg(F.max_by(F.struct("id", *CATEGORIES, "branches"), rank).alias("b"))
    return best.select("class_code", "b.*")


def rows_of(category: Column) -> Column:
    """The class's array of a category."""
    out = F.when(category == CATEGORIES[0], F.col(CATEGORIES[0]))
    for c in CATEGORIES[1:]:
        out = out.when(category == c, F.col(c))
    return out


def of_type(rows: Column, hint: Column) -> Column:
    fits = lambda r: (hint["hint"] == "") | (F.lower(r["label"]).contains(hint["hint"]) & ~F.exists(hint["excludes"], lambda e: F.lower(r["label"]).contains(e)))
    return F.filter(rows, fits)


def in_range(rows: Column, x: Column) -> Column:
    return F.filter(rows, lambda r: F.coalesce((r["lo"] - 1e-9 <= x) & (x <= r["hi"] + 1e-9), F.lit(False)))


def of_rating(rows: Column, text: Column) -> Column:
    """Rows that do not contradict the rating a text names."""
    named = T.class_rating(text)
    return F.filter(rows, lambda r: (r["rating"] == "") | named.isNull() | (r["rating"] == named))


def check_bom(bom: DataFrame, classes: DataFrame) -> DataFrame:
    """``bom`` (class_code, hint, dn and others) with ``verdict``, ``pos`` and ``category`` of the first row of its type and size."""
    j = bom.join(classes.drop("id", "branches").withColumn("known", F.lit(True)), "class_code", "left")
    j = j.withColumn("_rows", rows_of(F.col("hint.category"))).withColumn("_hit", F.get(in_range(of_type(F.col("_rows"), F.col("hint")), F.col("dn")), F.lit(0)))
    verdict = (
        F.when(F.col("hint").isNull(), "out_of_scope").when(F.col("known").isNull(), "class_not_found").when(F.col("dn").isNull(), "size_unrecognized")
        .when(F.size("_rows") == 0, "no_client_data").when(F.col("_hit").isNull(), "not_found").otherwise("match")
    )
    hit = lambda c: F.when(F.col("verdict") == "match", F.col(f"_hit.{c}"))
    return j.withColumn("verdict", verdict).select(*bom.columns, "verdict", hit("pos").alias("pos"), F.when(F.col("verdict") == "match", F.col("hint.category")).alias("category"), hit("size_min").alias("row_min"), hit("size_max").alias("row_max"))


def _staged(items: DataFrame, classes: DataFrame) -> DataFrame:
    """Items with their class, hint and the rows of each stage: of the type, of the type and size, of size and rating of any type."""
    text = F.concat(F.coalesce("description", F.lit("")), F.lit(" "), F.coalesce("material", F.lit("")))
    i = items.withColumn("text", text).withColumn("hint", item_hint(F.col("type"), F.col("text"))).withColumn("dn", known_dn(F.col("size_p1"))).withColumn("branch_dn", known_dn(F.col("size_p2")))
    j = i.join(classes.drop("id").withColumn("known", F.lit(True)), "class_code", "left").withColumn("rows", rows_of(F.col("hint.category")))
    j = j.withColumn("typed", of_type(F.col("rows"), F.col("hint")))
    j = j.withColumn("sized", F.when(F.col("dn").isNull(), F.col("typed")).otherwise(in_range(F.col("typed"), F.col("dn"))))
    broad = in_range(of_rating(F.col("rows"), F.col("text")), F.col("dn"))
    closed = F.col("hint.branch") | F.col("dn").isNull() | (F.size("typed") > 0)
    return j.withColumn("broad", F.when(~closed, broad).otherwise(F.slice("rows", 1, 0)))


def check_items(items: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, verdict, pos) of every item of an item list (id, class_code, type, description, material, size_p1, size_p2).

    The verdict is the first that holds: out_of_scope (code unknown), class_not_found, size_unrecognized, for branches with a
    second size the class's branch cell (not_found, no_client_data without material, match), no_client_data (no rows of the
    category), match (the first row of type, size and rating, else of type and size), not_found (rows of the type, none of the
    size), mismatch (no row of the type, but one of the size).
    """
    j = _staged(items, classes)
    near = lambda a, b: F.abs(S.nps(a) - b) < 1e-6
    cells = F.filter("branches", lambda b: F.coalesce(near(b["header_size"], F.col("dn")) & near(b["branch_size"], F.col("branch_dn")), F.lit(False)))
    j = j.withColumn("cell", F.get(cells, F.lit(0)))
    by_cell = F.col("hint.branch") & (F.coalesce("size_p2", F.lit("")) != "") & F.col("dn").isNotNull() & F.col("branch_dn").isNotNull() & (F.size("branches") > 0)
    rated = of_rating(F.col("sized"), F.col("text"))
    picked = F.when(F.size("sized") > 0, F.coalesce(F.get(rated, F.lit(0)), F.get("sized", F.lit(0)))).otherwise(F.get("broad", F.lit(0)))
    j = j.withColumn("picked", picked)
    verdict = (
        F.when(F.col("hint").isNull(), "out_of_scope").when(F.col("known").isNull(), "class_not_found").when(F.col("dn").isNull() & ~F.col("hint.optional"), "size_unrecognized")
        .when(by_cell & F.col("cell").isNull(), "not_found").when(by_cell & (F.coalesce("cell.material", F.lit("")) == ""), "no_client_data").when(by_cell, "match")
        .when(F.size("rows") == 0, "no_client_data").when(F.size("sized") > 0, "match").when(F.size("broad") > 0, "mismatch").otherwise("not_found")
    )
    j = j.withColumn("verdict", verdict)
    return j.select("id", "verdict", F.when(F.col("verdict").isin("match", "mismatch") & ~F.coalesce(by_cell, F.lit(False)), F.col("picked.pos")).alias("pos"), F.when(F.col("hint").isNull(), F.try_element_at(F.create_map(*[F.lit(x) for kv in OUT_OF_SCOPE.items() for x in kv]), F.col("type"))).alias("note"))


def substantiated(items: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, class_code, category, pos, label): every class row an item could stand for, and (pos null) items whose type the
    class has but not in their size, under the label of the first row of the type."""
    j = _staged(items, classes).filter(F.col("hint").isNotNull() & F.col("known") & (F.col("dn").isNotNull() | F.col("hint.optional")))
    rated = of_rating(F.col("sized"), F.col("text"))
    rows = F.when(F.size(rated) > 0, rated).when(F.size("sized") > 0, F.col("sized")).otherwise(F.col("broad"))
    spot = lambda r: F.struct(r["pos"].alias("pos"), r["label"].alias("label"))
    first = F.coalesce(T.or_null(T.trimmed(F.get("typed", F.lit(0))["label"])), F.lit("Other"))
    lost = F.when((F.size("typed") > 0) & F.col("dn").isNotNull(), F.array(F.struct(F.lit(None).cast("int").alias("pos"), first.alias("label")))).otherwise(F.array().cast("array<struct<pos:int,label:string>>"))
    return j.withColumn("_c", F.when(F.size(rows) > 0, F.transform(rows, spot)).otherwise(lost)).select("id", "class_code", F.col("hint.category").alias("category"), F.inline("_c"))


def shown(category: str, r: Column) -> dict[str, Column]:
    """What a class table shows of a row: type, end type, rating or schedule, description."""
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    rating = {"pipes": dash(r["schedule"]), "fittings": F.lit(FITTING_RATING)}.get(category, dash(r["rating"]))
    return {"type": F.lit("Pipe") if category == "pipes" else dash(r["label"]), "end_type": dash(r["end_type"]), "rating": rating, "text": dash(T.trimmed(F.coalesce(r["description"], r["material"])))}


def _displayed(category: str, r: Column) -> Column:
    return F.struct(r["pos"].alias("pos"), *[v.alias(k) for k, v in shown(category, r).items()], r["size_min"].alias("size_min"), r["size_max"].alias("size_max"))


def class_bands(classes: DataFrame) -> DataFrame:
    """(class_code, category, band, type, end_type, rating, text, size_min, size_max, positions): adjacent rows that show the same
    as one band from the first row's least to the last row's greatest size. One fold over each array, no shuffle."""
    parts = []
    for c in CATEGORIES:
        display = lambda r: _displayed(c, r)  # noqa: E731, B023
        seen = F.transform(c, display)
        start = F.array().cast("array<struct<type:string,end_type:string,rating:string,text:string,size_min:string,size_max:string,positions:array<int>>>")
        same = lambda a, b: (a["type"] == b["type"]) & (a["end_type"] == b["end_type"]) & (a["rating"] == b["rating"]) & (a["text"] == b["text"])
        entry = lambda r, lo, p: F.struct(*[r[k].alias(k) for k in ("type", "end_type", "rating", "text")], lo.alias("size_min"), r["size_max"].alias("size_max"), p.alias("positions"))

        def step(acc: Column, r: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(entry(r, last["size_min"], F.concat(last["positions"], F.array(r["pos"])))))
            return F.when((F.size(acc) > 0) & F.coalesce(same(last, r), F.lit(False)), longer).otherwise(F.concat(acc, F.array(entry(r, r["size_min"], F.array(r["pos"])))))

        parts.append(classes.select("class_code", F.lit(c).alias("category"), F.posexplode(F.aggregate(seen, start, step)).alias("band", "b")).select("class_code", "category", "band", "b.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_fields(pairs: DataFrame) -> DataFrame:
    """Adds ``fields``: array<struct<field, admin, client, verdict>> of an item beside a band, each match, differs or unknown.

    pairs: category, item_text, item_dn, rating, end_type, text, lo, hi.
    """
    t, c = F.col("item_text"), F.col("text")
    grades, theirs = T.tokens(t, T.GRADE), T.tokens(c, T.GRADE)
    standards, other = T.standards(t), T.standards(c)
    told = F.when(F.col("category") == "pipes", T.schedule(t)).otherwise(T.class_rating(t))
    empty = F.col("rating").isin("", "-", FITTING_RATING)
    bare = lambda v: F.regexp_replace(F.upper(v), r"^0+(?=\d)", "")
    end = T.end_type(t)
    x = F.col("item_dn")
    say = lambda unknown, same: F.when(F.coalesce(unknown, F.lit(True)), "unknown").when(same, "match").otherwise("differs")
    some = lambda a: T.or_null(F.array_join(a, ", "))
    rows = [
        ("Size", x.cast("int").cast("string"), F.concat_ws("-", F.col("lo").cast("int").cast("string"), F.col("hi").cast("int").cast("string")), say(x.isNull() | F.col("lo").isNull() | F.col("hi").isNull(), (F.col("lo") - 1e-9 <= x) & (x <= F.col("hi") + 1e-9))),
        ("Material", some(grades), some(theirs), say((F.size(grades) == 0) | (F.size(theirs) == 0), F.arrays_overlap(grades, theirs))),
        ("Schedule / Class", told, F.when(~empty, F.col("rating")), say(told.isNull() | empty, bare(told) == bare(F.col("rating")))),
        ("End Type", end, F.when(F.col("end_type") != "-", F.col("end_type")), say(end.isNull() | (F.col("end_type") == "-"), end == F.upper("end_type"))),
        ("Standard", some(standards), some(other), say((F.size(standards) == 0) | (F.size(other) == 0), F.arrays_overlap(standards, other))),
    ]
    return pairs.withColumn("fields", F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(a, F.lit("-")).alias("admin"), F.coalesce(b, F.lit("-")).alias("client"), v.alias("verdict")) for n, a, b, v in rows]))


def without_details(v: Column) -> Column:
    """Text without trim and bonnet details, its empty segments closed up."""
    for p in DETAILS:
        v = F.regexp_replace(v, p, " ")
    parts = F.filter(F.transform(F.split(v, ","), T.trimmed), lambda s: s != "")
    return F.trim(F.regexp_replace(F.array_join(parts, ", "), r"\s{2,}", " "))


def valve_status(valves: DataFrame, classes: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """``valves`` (class_code, dn and others) with the class's first valve row of their size, whatever its type.

    status: size_unrecognized, no_client_data (no such class), not_found or match. admin: whether an item of the list stands
    for that row (rows of `substantiated`); null where no class row is found or the class has no items at all.
    """
    x = F.when(S.nps_of_dn(F.col("dn").cast("string")).isNotNull(), F.col("dn").cast("double"))
    j = valves.join(classes.select("class_code", F.col("valves").alias("_v"), F.lit(True).alias("known")), "class_code", "left").withColumn("_hit", F.get(in_range(F.col("_v"), x), F.lit(0)))
    status = F.when(x.isNull(), "size_unrecognized").when(F.col("known").isNull(), "no_client_data").when(F.col("_hit").isNull(), "not_found").otherwise("match")
    j = j.select(*valves.columns, status.alias("status"), F.when(status == "match", F.col("_hit.pos")).alias("pos"))
    if confirmed is None:
        return j.withColumn("admin", F.lit(None).cast("boolean"))
    listed = confirmed.select(F.col("class_code").alias("_c")).distinct()
    rows = confirmed.filter("category = 'valves' and pos is not null").select(F.col("class_code").alias("_rc"), F.col("pos").alias("_rp")).distinct()
    j = j.join(listed, F.col("class_code") == F.col("_c"), "left").join(rows, (F.col("class_code") == F.col("_rc")) & (F.col("pos") == F.col("_rp")), "left")
    return j.select(*valves.columns, "status", "pos", F.when(F.col("pos").isNotNull() & F.col("_c").isNotNull(), F.col("_rp").isNotNull()).alias("admin"))
