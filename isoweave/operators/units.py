"""Quantities in different units brought to one unit each (problem 2).

Both sources of a design-basis row describe the same line and field. For each
pair of unit spellings a scale and an offset are estimated from all rows that
hold the pair, robustly (median of slopes over hash buckets, then median of
residuals), snapped to the nearest ratio of known units, kept where most rows
agree with it, and propagated from the unit that unlabelled values are in by
definition. Spellings with too few rows take the unit that their name means.

Estimates are grouped aggregates that combine before the shuffle; only tables of
distinct spellings are joined afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import quantity as Q
from ..runtime import guarded_broadcast, materialise

#: Rows that a pair of spellings needs for its estimate to count, and the share of them that must agree with it.
MIN_SUPPORT, MIN_AGREEMENT = 12, 0.5
#: Relative distance within which a scale snaps, share within which a row agrees, buckets of the slope estimate.
SNAP, AGREE, BUCKETS = 0.008, 0.004, 64
#: Steps of propagation through the graph of spellings.
HOPS = 3


@dataclass
class Harmonised:
    """``rows``: the input with ``quantity, iso_common, pll_common``; ``units``: what each spelling was taken for."""

    rows: DataFrame
    units: DataFrame


def known_units(spark: SparkSession) -> DataFrame:
    rows = [(q, k, s, o) for q, us in Q.KNOWN_UNITS.items() for s, o, keys in us for k in keys]
    return spark.createDataFrame(rows, "quantity string, unit string, scale double, offset double")


def _ratios(spark: SparkSession) -> DataFrame:
    """All conversions y = s x + o between two known units of a quantity."""
    rows = {
        (q, round(a[0] / b[0], 12), round((a[1] - b[1]) / b[0], 9)) for q, us in Q.KNOWN_UNITS.items() for a in us for b in us
    }
    return spark.createDataFrame(sorted(rows), "quantity string, snap_scale double, snap_offset double")


def estimate_edges(pairs: DataFrame) -> DataFrame:
    """(quantity, ua, ub, scale, offset, support, agreement) with b = scale * a + offset, snapped to known ratios.

    pairs: quantity, ua, ub, a, b, salt (a hash of the row).
    """
    g = ["quantity", "ua", "ub"]
    bucketed = (
        pairs.groupBy(*g, F.pmod("salt", F.lit(BUCKETS)).alias("bucket"))
        .agg(F.count("*").alias("n"), F.min_by(F.struct("a", "b"), "a").alias("lo"), F.max_by(F.struct("a", "b"), "a").alias("hi"))
        .withColumn("slope", F.when(F.col("hi.a") > F.col("lo.a") * 1.05 + 0.5, (F.col("hi.b") - F.col("lo.b")) / (F.col("hi.a") - F.col("lo.a"))))
    )
    slopes = bucketed.groupBy(*g).agg(F.sum("n").alias("support"), F.median("slope").alias("slope"))
    ratios = pairs.filter(F.abs("a") > 1e-9).groupBy(*g).agg(F.percentile_approx(F.col("b") / F.col("a"), 0.5, 2000).alias("ratio"))
    # Pressures and lengths have no offset, so the median ratio is the better estimate of their scale.
    est = slopes.join(ratios, g, "left").withColumn("est", F.when(F.col("quantity") == "temperature", F.col("slope")).otherwise(F.col("ratio")))
    est = materialise(est.filter(F.col("support") >= MIN_SUPPORT).select(*g, "support", "est"), "unit-slopes")
    snaps = F.broadcast(_ratios(pairs.sparkSession))  # a constant table of the known units
    cand = est.join(snaps, "quantity").filter(F.abs(F.col("snap_scale") / F.col("est") - 1) < F.when(F.col("quantity") == "temperature", 0.25).otherwise(SNAP))
    # Which candidate the rows agree with: counted over all rows of the pair.
    checked = (
        pairs.join(guarded_broadcast(cand), g)
        .withColumn("err", F.abs(F.col("snap_scale") * F.col("a") + F.col("snap_offset") - F.col("b")))
        .groupBy(*g, "support", "snap_scale", "snap_offset")
        .agg(F.avg((F.col("err") <= F.when(F.col("quantity") == "temperature", 0.6).otherwise(AGREE * F.abs("b") + 1e-6)).cast("double")).alias("agreement"))
    )
    best = checked.groupBy(*g).agg(F.max(F.struct("agreement", "support", F.col("snap_scale").alias("scale"), F.col("snap_offset").alias("offset"))).alias("x"))
    return best.select(*g, "x.*").filter(F.col("agreement") >= MIN_AGREEMENT)


def propagate(edges: DataFrame) -> DataFrame:
    """(quantity, unit, scale, offset) to the common unit for all spellings within HOPS edges of unlabelled values."""
    both = edges.select("quantity", F.col("ua").alias("u"), F.col("ub").alias("w"), "scale", "offset", "support").unionByName(
        edges.select("quantity", F.col("ub").alias("u"), F.col("ua").alias("w"), (1 / F.col("scale")).alias("scale"), (-F.col("offset") / F.col("scale")).alias("offset"), "support")
    )
    both = materialise(both, "unit-edges")
    spark = edges.sparkSession
    known = spark.createDataFrame([(q, "", 1.0, 0.0, 0) for q in Q.KNOWN_UNITS], "quantity string, unit string, scale double, offset double, hop int")
    first = Window.partitionBy("quantity", "unit").orderBy("hop", F.desc("support"), "scale")
    for hop in range(1, HOPS + 1):
        reached = both.join(known.select("quantity", F.col("unit").alias("w"), F.col("scale").alias("ks"), F.col("offset").alias("ko")), ["quantity", "w"]).select(
            "quantity", F.col("u").alias("unit"), (F.col("ks") * F.col("scale")).alias("scale"), (F.col("ks") * F.col("offset") + F.col("ko")).alias("offset"), F.lit(hop).alias("hop"), "support"
        )
        known = (
            known.withColumn("support", F.lit(None).cast("bigint")).unionByName(reached).withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r", "support")
        )
    return known


def read(values: DataFrame, text: str, number: str, unit: str) -> DataFrame:
    """Adds the number of a text (null if not given) and the spelling of the unit beside it."""
    return values.withColumn(number, F.when(~Q.not_given(F.col(text)), Q.number(F.col(text)))).withColumn(unit, Q.unit_beside(F.col(text)))


def link(values: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of two sources that state one quantity of one line: ``keys, quantity, ua, ub, a, b``, each once.

    values: keys, quantity, number, unit; others the same, in any number per key. Null keys link nothing.
    """
    v = values.select(*keys, "quantity", F.col("unit").alias("ua"), F.col("number").alias("a")).filter("a is not null").distinct()
    o = others.select(*keys, "quantity", F.col("unit").alias("ub"), F.col("number").alias("b")).filter("b is not null").distinct()
    return v.join(o, [*keys, "quantity"]).select(*keys, "quantity", "ua", "ub", "a", "b")


def harmonise(df: DataFrame, field: str = "field", iso: str = "iso_value", pll: str = "pll_value", remarks: str = "remarks", key: str = "id", linked: DataFrame | None = None) -> Harmonised:
    """Bring both values of every quantity row to barg, °C or mm.

    linked: pairs of values from other sources (``quantity, ua, ub, a, b``) that the estimates take in beside the rows.
    Rows of other fields are left out. A value that is not given, or whose unit is neither estimated nor known
    by name, has a null common value. An empty table gives empty results; repeated rows are kept; null keys are kept.
    """
    q = Q.quantity_of(F.col(field))
    src = df.withColumn("quantity", q).filter(F.col("quantity").isNotNull())
    for side, col in (("iso", iso), ("pll", pll)):
        unit = Q.unit_beside(F.col(col))
        label = Q.remark_unit(F.col(remarks), side.upper(), F.col("quantity"))
        src = src.withColumn(f"{side}_number", F.when(~Q.not_given(F.col(col)), Q.number(F.col(col))))
        src = src.withColumn(f"{side}_unit", F.when(unit != "", unit).otherwise(label))
    pairs = src.filter(F.col("iso_number").isNotNull() & F.col("pll_number").isNotNull()).select(
        "quantity", F.col("iso_unit").alias("ua"), F.col("pll_unit").alias("ub"), F.col("iso_number").alias("a"), F.col("pll_number").alias("b"), F.xxhash64(key).alias("salt")
    )
    if linked is not None:
        cols = ["quantity", "ua", "ub", "a", "b"]
        pairs = pairs.unionByName(linked.select(*cols, F.xxhash64(*linked.columns).alias("salt")))
    learned = propagate(estimate_edges(materialise(pairs, "unit-pairs")))
    named = known_units(df.sparkSession)
    units = learned.withColumn("basis", F.when(F.col("unit") == "", "definition").otherwise("estimated")).drop("hop").join(
        named.select("quantity", "unit", F.col("scale").alias("ns"), F.col("offset").alias("no")), ["quantity", "unit"], "full_outer"
    )
    units = materialise(
        units.select(
            "quantity", "unit", F.coalesce("scale", "ns").alias("scale"), F.coalesce("offset", "no").alias("offset"), F.coalesce("basis", F.lit("name")).alias("basis")
        ),
        "units",
    )
    rows = src
    for side in ("iso", "pll"):
        u = units.select("quantity", F.col("unit").alias(f"{side}_unit"), F.col("scale").alias("_s"), F.col("offset").alias("_o"))
        rows = rows.join(guarded_broadcast(u), ["quantity", f"{side}_unit"], "left")
        rows = rows.withColumn(f"{side}_common", F.col(f"{side}_number") * F.col("_s") + F.col("_o")).drop("_s", "_o")
    return Harmonised(rows, units)


def differ(quantity: Column, a: Column, b: Column) -> Column:
    """Not the same quantity: over 1 % of the larger apart, for temperatures over 1 °C."""
    gap = F.abs(a - b)
    return F.when(quantity == "temperature", gap > 1.0 + 1e-6).otherwise(gap > 0.01 * F.greatest(F.abs(a), F.abs(b)) + 1e-9)


def convert(values: DataFrame, units: DataFrame, quantity: str, text: str) -> DataFrame:
    """Adds ``common``: the value of a text in the common unit of its quantity; null if not given or of no known unit."""
    u = units.select(F.col("quantity").alias("_q"), F.col("unit").alias("_u"), F.col("scale").alias("_s"), F.col("offset").alias("_o"))
    v = values.withColumn("_n", F.when(~Q.not_given(F.col(text)), Q.number(F.col(text)))).withColumn("_k", Q.unit_beside(F.col(text)))
    j = v.join(guarded_broadcast(u), (v[quantity] == F.col("_q")) & (F.col("_k") == F.col("_u")), "left")
    return j.withColumn("common", F.col("_n") * F.col("_s") + F.col("_o")).drop("_n", "_k", "_q", "_u", "_s", "_o")
