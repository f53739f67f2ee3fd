"""Spool analytics: citations in notes, quality flags, landmark clusters, dimension chains, orientation in containers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import COORDINATE, WELD_TAG, blank, tokens
from ..runtime import materialise
from .relational import components

# Patterns of notes, longest chain of dimensions.
CITATION = r"\b[FGB]\s*0*\d+\b|\b[iI][tT][eE][mM]\s*0*\d+\b"
REDUCING_ITEM = r"(?i)\bitem\s*0*(\d+)\s*\(?\s*(?:weldolet|tee)\b"
PASS_THROUGH = r"(?i)\bthrough\b[^.]{0,60}\bvalves?\b"
BRANCH, BOUND = r"(?i)\bbranch\s+legs?\b", r"(?i)\bbound(?:ed|ary)?\b"
MAX_CHAIN = 4
# End of fixed values.


def citations(text: Column) -> Column:
    """array<struct<raw, item_no, start>> of cited items, in order and without overlaps; start counts characters from 0.

    Matches of one alternation never overlap, and each one's place follows from the lengths of the texts between them.
    """
    found = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))
    gaps = F.split(text, CITATION)
    item = lambda m: F.regexp_extract(m, r"0*(\d+)$", 1)
    step = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    start = F.struct(F.array().cast("array<struct<raw:string,item_no:string,start:int>>").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(
        step, start,
        lambda acc, x: F.struct(F.concat(acc["out"], F.array(F.struct(x["m"].alias("raw"), item(x["m"]).alias("item_no"), (acc["at"] + x["g"]).alias("start")))).alias("out"), (acc["at"] + x["g"] + F.length(x["m"])).alias("at")),
        lambda acc: acc["out"],
    )


def cited_items(notes: DataFrame, bom: DataFrame, keys: list[str]) -> DataFrame:
    """One row per citation with the first bill row of that number on the sheet; ``ambiguous`` if there are several.

    notes: keys, note_id, note. bom: keys, item_no, bom_id, component_type.
    """
    each = notes.select(*keys, "note_id", F.posexplode(citations(F.col("note"))).alias("n", "c")).select(*keys, "note_id", "n", "c.*")
    items = bom.groupBy(*keys, "item_no").agg(F.min(F.struct("bom_id", "component_type")).alias("b"), F.count("*").alias("hits"))
    return each.join(items, [*keys, "item_no"], "left").select(*keys, "note_id", "n", "raw", "item_no", "start", F.col("b.bom_id").alias("bom_id"), F.col("b.component_type").alias("component_type"), F.coalesce(F.col("hits") > 1, F.lit(False)).alias("ambiguous"))


def gasket_without_flange(cited: DataFrame) -> DataFrame:
    """Notes that cite a gasket and no flange."""
    t = F.upper("component_type")
    return cited.groupBy("note_id").agg(F.max((t == "GASKET").cast("int")).alias("g"), F.max((t == "FLANGE").cast("int")).alias("f")).filter("g = 1 and coalesce(f, 0) = 0").select("note_id")


def boundary_flags(note: Column) -> Column:
    """Doubts about a spool's boundary note, in order: bounded by a branch leg, runs through a valve."""
    out = F.array(F.when(note.rlike(BRANCH) & note.rlike(BOUND), "branch boundary"), F.when(note.rlike(PASS_THROUGH), "through valve"))
    return F.array_compact(out)


def same_size_items(welds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, weld_id, item_no): welds of a reducing item that all have one and the same stated size, two welds at least."""
    w = welds.withColumn("item_no", F.regexp_extract("note", REDUCING_ITEM, 1)).filter("item_no <> ''").withColumn("item_no", F.regexp_replace("item_no", r"^0+(?=\d)", ""))
    stated = F.when(~blank(F.col("size")), F.col("size"))
    bad = w.groupBy(*keys, "item_no").agg(F.count("*").alias("n"), F.countDistinct(stated).alias("sizes")).filter("n >= 2 and sizes = 1")
    return w.join(bad, [*keys, "item_no"], "left_semi").select(*keys, "weld_id", "item_no")


def landmarks(ref: Column) -> Column:
    """Coordinates and weld tags that a dimension's end names."""
    return F.array_union(F.coalesce(tokens(ref, COORDINATE), F.array().cast("array<string>")), F.coalesce(tokens(ref, WELD_TAG), F.array().cast("array<string>")))


def clustered_sum(dims: DataFrame, group: list[str], key: str, value: str, refs: list[str]) -> DataFrame:
    """Sum over a group's dimensions where those that share a landmark count once, with the largest.

    Clusters are connected components over (group, landmark); dimensions without landmarks stand alone.
    """
    named = dims.select(*group, key, value, F.concat_ws("|", *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group]).alias("_g"), reduce(F.array_union, [landmarks(F.col(r)) for r in refs]).alias("_l"))
    edges = named.select(F.concat(F.lit("d|"), F.col("_g"), F.lit("|"), F.col(key).cast("string")).alias("a"), F.explode("_l").alias("x"), "_g").select("a", F.concat(F.lit("l|"), F.col("_g"), F.lit("|"), "x").alias("b"))
    labels = components(edges)
    node = F.concat(F.lit("d|"), F.col("_g"), F.lit("|"), F.col(key).cast("string"))
    c = named.join(labels, node == F.col("node"), "left").withColumn("component", F.coalesce("component", node))
    return c.groupBy(*group, "component").agg(F.max(value).alias("m")).groupBy(*group).agg(F.sum("m").alias("total"))


def chains(pieces: DataFrame, dims: DataFrame, group: list[str]) -> DataFrame:
    """(group, piece_id, chain, total): for each cut piece the shortest chain of dimensions between its ends, first by ids.

    pieces: group, piece_id, from_ref, to_ref. dims: group, dim_id, from_ref, to_ref, value. Ends meet where they name a
    common weld tag or coordinate. Chains are at most MAX_CHAIN long and use no dimension twice.
    """
    d = dims.filter("value is not null and value <> 0").select(*group, "dim_id", "value", landmarks(F.col("from_ref")).alias("a"), landmarks(F.col("to_ref")).alias("b"))
    both = d.unionByName(d.select(*group, "dim_id", "value", F.col("b").alias("a"), F.col("a").alias("b"))).filter(F.size("a") > 0)
    starts = both.select(*group, "dim_id", "value", "b", F.explode("a").alias("at"))
    p = pieces.select(*group, "piece_id", landmarks(F.col("from_ref")).alias("here"), landmarks(F.col("to_ref")).alias("goal")).filter((F.size("here") > 0) & (F.size("goal") > 0))
    state = p.select(*group, "piece_id", "goal", F.col("here").alias("end"), F.array().cast("array<bigint>").alias("chain"), F.lit(0.0).alias("total"))
    found = None
    for hop in range(1, MAX_CHAIN + 1):
        at = state.select("*", F.explode("end").alias("at"))
        state = at.join(starts, [*group, "at"]).filter(~F.array_contains("chain", F.col("dim_id").cast("bigint")))
        state = state.select(*group, "piece_id", "goal", F.col("b").alias("end"), F.concat("chain", F.array(F.col("dim_id").cast("bigint"))).alias("chain"), (F.col("total") + F.col("value")).alias("total")).distinct()
        state = materialise(state, "chain")
        hit = state.filter(F.arrays_overlap("end", "goal")).select(*group, "piece_id", F.struct(F.lit(hop).alias("hops"), "chain", "total").alias("c"))
        found = hit if found is None else found.unionByName(hit)
        # A piece that is met has its shortest chain: it goes no further.
        state = state.join(hit.select(*group, "piece_id").distinct(), [*group, "piece_id"], "left_anti")
    return found.groupBy(*group, "piece_id").agg(F.min("c").alias("c")).select(*group, "piece_id", "c.chain", "c.total")


def orientation(box: Column, inner: tuple[float, float, float]) -> Column:
    """struct<axes, clearance>: which box side lies along each side of a container so that the least clearance is greatest.

    Of equal orientations the first in the order of axes holds; null if none fits.
    """
    perms = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    options = F.array(*[F.struct(F.least(*[F.lit(float(inner[k])) - box[i] for k, i in enumerate(p)]).alias("clearance"), F.lit(-n).alias("o"), F.lit("".join("xyz"[i] for i in p)).alias("axes")) for n, p in enumerate(perms)])
    best = F.array_max(F.filter(options, lambda s: s["clearance"] >= 0))
    return F.when(best.isNotNull(), F.struct(best["axes"].alias("axes"), best["clearance"].alias("clearance")))


def shares_joint(a: Column, b: Column) -> Column:
    """Whether two ends name a common weld tag or coordinate."""
    both = lambda p: F.coalesce(F.arrays_overlap(tokens(a, p), tokens(b, p)), F.lit(False))
    return both(WELD_TAG) | both(COORDINATE)


def meets_weld(tag: Column, note: Column, end: Column) -> Column:
    """Whether a dimension's end names a weld, or a coordinate of its note."""
    named = F.array_contains(tokens(end, WELD_TAG), F.upper(F.regexp_replace(tag, r"\s+", "")))
    return F.coalesce(named, F.lit(False)) | F.coalesce(F.arrays_overlap(tokens(note, COORDINATE), tokens(end, COORDINATE)), F.lit(False))


def dimension_kind(one: Column, other: Column, manual: Column) -> Column:
    """Kind of a dimension by its ends: the kind set by hand first, a valve if either end is one, else the first that is known."""
    return F.coalesce(manual, F.when((one == "valve") | (other == "valve"), "valve"), one, other)
