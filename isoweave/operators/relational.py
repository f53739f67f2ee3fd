"""Ordered and grouped operators that the cross-checks share.

"First" always has an explicit order: by tag id or by position in an array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sizes import nps
from ..functions.text import blank


def pick_row(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """First (or last) row per key by ``order``; one aggregate that combines before the shuffle, no window."""
    rest = [c for c in df.columns if c not in keys]
    choose = F.max if last else F.min
    return df.groupBy(*keys).agg(choose(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def latest(df: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """Newest row per key; rows without a time lose to any with one, ties go to the highest ``tie``."""
    return pick_row(df.withColumn("_w", F.coalesce(when, F.lit("1900-01-01").cast("timestamp"))), keys, ["_w", tie], last=True).drop("_w")


def merge_lines(lines: DataFrame, keys: list[str], fields: list[str], order: list[str], last: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: of each field the first stated value in order, of ``last`` fields the last stated one."""
    spot = F.struct(*order)
    return lines.groupBy(*keys).agg(*[(F.max_by if f in last else F.min_by)(f, F.when(~blank(F.col(f)), spot)).alias(f) for f in fields], F.count("*").alias("sheets"))


def bands(rows: DataFrame, part: list[str], pos: str, same: list[str]) -> DataFrame:
    """Adjacent rows with equal ``same`` columns merged: first and last position, number of rows. Null equals null."""
    w = Window.partitionBy(*part).orderBy(pos)
    alike = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lag(c).over(w)) for c in same])
    marked = rows.withColumn("_new", F.when((F.row_number().over(w) > 1) & alike, 0).otherwise(1))
    island = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = [F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count("*").alias("rows"), F.min_by("size_min", pos).alias("size_min"), F.max_by("size_max", pos).alias("size_max")]
    return island.groupBy(*part, "_i", *same).agg(*merged).drop("_i")


def overlaps(rows: DataFrame, part: list[str], lo: str, hi: str, pos: str) -> DataFrame:
    """Rows that begin at or below the end of the row before them among those with a range, in order of size."""
    r = rows.select("*", nps(F.col(lo)).alias("_lo"), nps(F.col(hi)).alias("_hi")).filter("_lo is not null and _hi is not null")
    w = Window.partitionBy(*part).orderBy("_lo", "_hi", pos)
    return r.withColumn("_before", F.lag("_hi").over(w)).filter(F.col("_lo") <= F.col("_before") + 1e-9).drop("_before", "_lo", "_hi")


def compact_ranges(tags: DataFrame, part: list[str], prefix: str, num: str, raw: str, order: str | None = None) -> DataFrame:
    """Runs of consecutive numbers per prefix as one text a group: SW01-SW06, FW01; prefixes as first seen by ``order``, else alphabetical."""
    seen = F.min(order) if order else F.lit(0)
    one = tags.groupBy(*part, prefix, num).agg(F.min(raw).alias(raw), seen.alias("_o"))
    w = Window.partitionBy(*part, prefix)
    numbered = one.withColumn("_run", F.col(num) - F.row_number().over(w.orderBy(num))).withColumn("_o", F.min("_o").over(w))
    runs = numbered.groupBy(*part, "_o", prefix, "_run").agg(F.min(num).alias("a"), F.min_by(raw, num).alias("x"), F.max_by(raw, num).alias("y"))
    text = runs.withColumn("t", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.concat("x", F.lit("-"), "y")))
    return text.groupBy(*part).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", prefix, "a", "t"))), lambda s: s["t"]), ", ").alias("ranges"))


def first_in_range(left: DataFrame, right: DataFrame, keys: list[str], x: str, lo: str, hi: str, order: str, also: Column | None = None) -> DataFrame:
    """Left rows with the position of the first right row of equal keys whose range holds ``x`` (null if none does)."""
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], nps(F.col(lo)).alias("_lo"), nps(F.col(hi)).alias("_hi"), F.col(order).alias("_pos"), *[F.col(c).alias(f"_r_{c}") for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys]) & (F.col("_lo") - 1e-9 <= F.col(x)) & (F.col(x) <= F.col("_hi") + 1e-9)
    hit = left.join(r, on if also is None else on & also, "left")
    return hit.groupBy(*left.columns).agg(F.min("_pos").alias("pos"))


def group_edges(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): edges with the components of all pairs of left and right ``node`` of equal keys, one a node instead of one a pair.

    All nodes of a group that has both sides are one component, so each is joined to the least of them (that one to
    itself). Null keys and nodes pair with nothing.
    """
    from ..runtime import guarded_broadcast, materialise

    side = lambda df, n: df.select("node", *keys, F.lit(n).alias("_side")).filter("node is not null")
    both = side(left, 0).unionByName(side(right, 1))
    paired = both.groupBy(*keys).agg(F.min("node").alias("b"), F.min("_side").alias("_lo"), F.max("_side").alias("_hi")).filter("_lo < _hi")
    return both.join(guarded_broadcast(materialise(paired.select(*keys, "b"), "paired")), keys).select(F.col("node").alias("a"), "b")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): connected components by alternating large-star and small-star steps; the label is the least node.

    Ends when the edges are stars around their least nodes, in O(log² n) rounds whatever the order of ids; raises after
    ``rounds``. Every round writes its edges to the shared folder, so the lineage stays short and no component is gathered.
    """
    from ..runtime import materialise

    given = materialise(edges.select("a", "b").filter("a is not null and b is not null").distinct(), "edges")
    nodes = given.select(F.col("a").alias("node")).unionByName(given.select(F.col("b").alias("node"))).distinct()
    links = given.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    for _ in range(rounds):
        # Large star: the larger neighbours of a node move to the least of its neighbours and itself.
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        links = materialise(both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "links")
        # Small star: a node and its smaller neighbours move to the least of these.
        least = links.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = links.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = materialise(least.select("hi", F.col("m").alias("lo")).unionByName(moved).distinct(), "links")
        parents = links.select(F.col("lo").alias("hi")).distinct()
        if links.join(parents, "hi", "left_semi").isEmpty() and links.groupBy("hi").count().filter("count > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return nodes.join(links, F.col("node") == F.col("hi"), "left").select("node", F.coalesce("lo", "node").alias("component"))
