"""Comparing quantities and texts of two documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WS, or_null, placeholder, trimmed

# Units that are brought to bar and to mm.
TO_BAR = {"bar": 1.0, "barg": 1.0, "bara": 1.0, "kpa": 0.01, "kpag": 0.01, "kpaa": 0.01, "mpa": 10.0, "mpag": 10.0, "psi": 0.0689476, "psig": 0.0689476, "kgcm2": 0.980665, "kg/cm2": 0.980665}
TO_MM = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4, '"': 25.4, "inch": 25.4}
# End of fixed values.


def prepared(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds number, unit, factor and blankness of both sides, each computed once, for `common` and `verdict`."""
    out = df.withColumns({"_ta": trimmed(F.col(a)), "_tb": trimmed(F.col(b))})
    none = lambda t: F.coalesce(placeholder(F.col(t)), F.lit(True))
    out = out.withColumns({"_ba": none("_ta"), "_bb": none("_tb")})
    first = lambda t: F.regexp_extract(F.regexp_replace(t, ",", ""), r"-?\d+(\.\d+)?", 0).try_cast("double")
    rest = lambda t: or_null(F.regexp_replace(F.lower(F.regexp_extract(t, rf"^-?[\d.,]+{WS}*(.*)$", 1)), f"{WS}+", ""))
    out = out.withColumns({f"_n{s}": F.when(~F.col(f"_b{s}"), first(f"_t{s}")) for s in "ab"} | {f"_u{s}": rest(f"_t{s}") for s in "ab"})
    out = out.withColumns({"_none": F.col("_ba") | F.col("_bb"), "_same": F.lower("_ta") == F.lower("_tb")})
    # Units are looked up in a constant table: maps and their conditions inlined per side outgrow generated code.
    rows = [F.struct(F.lit(k).alias("u"), F.lit(kind).alias("kind"), F.lit(v).alias("f")) for t, kind in ((TO_BAR, "p"), (TO_MM, "l")) for k, v in t.items()]
    units = df.sparkSession.range(1).select(F.inline(F.array(*rows)))
    for s in "ab":
        u = F.broadcast(units.select(F.col("u").alias(f"_k{s}"), F.col("kind").alias(f"_q{s}"), F.col("f").alias(f"_f{s}")))
        out = out.join(u, F.col(f"_u{s}") == F.col(f"_k{s}"), "left").drop(f"_k{s}")
    return out


def common() -> Column:
    """struct<a, b> in one unit; as they stand where a unit is missing or both are alike; null if not convertible."""
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    na, nb, ua, ub = (F.col(c) for c in ("_na", "_nb", "_ua", "_ub"))
    out = F.when(na.isNull() | nb.isNull(), None).when(ua.isNull() | ub.isNull() | (ua == ub), pair(na, nb))
    return out.when(F.col("_qa") == F.col("_qb"), pair(na * F.col("_fa"), nb * F.col("_fb")))


def agree(a: Column, b: Column) -> Column:
    """Equal within a millionth of the larger, of 1 at least."""
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * 1e-6


def verdict(numeric: bool) -> Column:
    """match, mismatch or not compared (a side is blank) of a prepared row; numbers that cannot be converted are compared as texts."""
    same = F.col("_same")
    if numeric:
        both = common()
        same = F.coalesce(agree(both["a"], both["b"]), same)
    return F.when(F.col("_none"), "not compared").when(same, "match").otherwise("mismatch")
