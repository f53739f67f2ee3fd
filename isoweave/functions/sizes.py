"""Nominal sizes: NPS and DN, both ways, ranges and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import number, trimmed

# The two nominal size tables; they are not inverses of each other.
NPS_TO_DN = {0.5: 15, 0.75: 20, 1: 25, 1.25: 32, 1.5: 40, 2: 50, 2.5: 65, 3: 80, 4: 100, 5: 125, 6: 150, 8: 200, 10: 250, 12: 300, 14: 350, 16: 400, 18: 450, 20: 500, 24: 600, 28: 700, 30: 750, 36: 900, 42: 1050, 48: 1200}
DN_TO_NPS = {6: 0.125, 8: 0.25, 10: 0.375, 15: 0.5, 20: 0.75, 25: 1, 32: 1.25, 40: 1.5, 50: 2, 65: 2.5, 80: 3, 90: 3.5, 100: 4, 115: 4.5, 125: 5, 150: 6}
# End of fixed values.
# From 8 inches on, 50 mm a step of two inches, up to 48.
DN_TO_NPS |= {25 * n: float(n) for n in range(8, 49, 2)}
#: Bare numbers up to this are inches.
INCH_LIMIT = 48


def _map(table: dict, key: str, value: str) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (float(k) if key == "double" else int(k), float(v) if value == "double" else int(v))])


def nps(v: Column) -> Column:
    """Inches of 36, 1.5, 1.1/2, 1 1/2 or 3/4, quotes taken off; null for other texts."""
    t = trimmed(F.regexp_replace(trimmed(v), '"', ""))
    mixed, part = r"^(\d+)(?:\.|\s+)(\d+)/(\d+)$", r"^(\d+)/(\d+)$"
    g = lambda p, i: F.regexp_extract(t, p, i).try_cast("double")
    plain = F.when(t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), t.try_cast("double"))
    return F.when(t.rlike(mixed), g(mixed, 1) + F.try_divide(g(mixed, 2), g(mixed, 3))).when(t.rlike(part), F.try_divide(g(part, 1), g(part, 2))).otherwise(plain)


def dn(v: Column) -> Column:
    """DN of the first size of a text. A bare number up to 48 is inches, whatever is written after it."""
    first = trimmed(F.split(v, "(?i)x|×")[0])
    frac = r"^(?:(\d+)\s+)?(\d+)\s*/\s*(\d+)"
    g = lambda i: F.regexp_extract(first, frac, i)
    value = F.when(g(2) != "", F.coalesce(g(1).try_cast("double"), F.lit(0.0)) + F.try_divide(g(2).try_cast("double"), g(3).try_cast("double"))).otherwise(number(first))
    inches = first.rlike("\"|inch|\\bin\\b|''") | (value <= INCH_LIMIT)
    listed = F.element_at(_map(NPS_TO_DN, "double", "int"), F.round(value, 2))
    near = lambda x: F.floor(x + 0.5).try_cast("int")
    return F.when(first == "", None).when(inches, F.coalesce(listed, near(value * 25.4))).otherwise(near(value))


def dn_label(d: Column) -> Column:
    inch = F.element_at(_map({v: k for k, v in NPS_TO_DN.items()}, "int", "double"), d)
    text = F.when(inch == F.floor(inch), F.floor(inch).cast("string")).otherwise(inch.cast("string"))
    return F.when(d.isNull(), "unsized").when(inch.isNotNull(), F.concat(text, F.lit('" (DN'), d.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("DN"), d.cast("string")))


def nps_of_dn(v: Column) -> Column:
    """Inches of a DN in mm; null where the list has none."""
    return F.element_at(_map(DN_TO_NPS, "int", "double"), F.floor(trimmed(v).try_cast("double") + 0.5).try_cast("int"))


def nps_label(v: Column) -> Column:
    """Inches as a whole number and reduced eighths."""
    whole = F.floor(v + 1e-9)
    e = F.floor((v - whole) * 8 + 0.5).cast("int")
    part = F.when(e % 4 == 0, F.concat((e / 4).cast("int").cast("string"), F.lit("/2"))).when(e % 2 == 0, F.concat((e / 2).cast("int").cast("string"), F.lit("/4"))).otherwise(F.concat(e.cast("string"), F.lit("/8")))
    return F.when(e == 0, whole.cast("string")).when(whole > 0, F.concat(whole.cast("string"), F.lit(" "), part)).otherwise(part)


def mended_range(lo: Column, hi: Column) -> Column:
    """struct<size_min, size_max, repaired>: a range that runs backwards was one mixed number cut in two."""
    bad = F.coalesce(nps(lo) > nps(hi), F.lit(False))
    both = F.concat(trimmed(lo), F.lit(" "), trimmed(hi))
    return F.struct(F.when(bad, both).otherwise(lo).alias("size_min"), F.when(bad, both).otherwise(hi).alias("size_max"), bad.alias("repaired"))


def range_holds(lo: Column, hi: Column, x: Column) -> Column:
    return F.coalesce((nps(lo) - 1e-9 <= x) & (x <= nps(hi) + 1e-9), F.lit(False))


def range_label(lo: Column, hi: Column) -> Column:
    return F.when(lo.isNotNull() & hi.isNotNull(), F.when(lo == hi, lo).otherwise(F.concat(lo, F.lit("–"), hi))).otherwise(F.coalesce(lo, hi, F.lit("-")))
