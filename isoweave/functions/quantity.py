"""Reading quantities written as text: number, unit spelling, placeholders, units named in remarks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known units by quantity as (scale, offset) to barg, °C and mm, with their usual spellings
# after `unit_key`. Pressures are gauge.
KNOWN_UNITS: dict[str, list[tuple[float, float, tuple[str, ...]]]] = {
    "pressure": [
        (1.0, 0.0, ("bar", "barg", "bara")),
        (0.001, 0.0, ("mbar", "mbarg")),
        (0.00001, 0.0, ("pa", "pag")),
        (0.01, 0.0, ("kpa", "kpag")),
        (10.0, 0.0, ("mpa", "mpag")),
        (0.0689476, 0.0, ("psi", "psig", "lbf/in2", "lbf/in2g", "lb/in2", "lb/in2g")),
        (0.980665, 0.0, ("kg/cm2", "kg/cm2g", "kgf/cm2", "kgf/cm2g", "kgcm2", "kscg", "ksc", "at", "atg")),
        (1.01325, 0.0, ("atm", "atmg")),
    ],
    "temperature": [
        (1.0, 0.0, ("c", "degc", "celsius")),
        (1.0, -273.15, ("k", "degk", "kelvin")),
        (5.0 / 9.0, -160.0 / 9.0, ("f", "degf", "fahrenheit")),
    ],
    "length": [
        (1.0, 0.0, ("mm",)),
        (10.0, 0.0, ("cm",)),
        (1000.0, 0.0, ("m",)),
        (25.4, 0.0, ('"', "in", "inch", "inches")),
    ],
}
# End of fixed values.


def tidy(v: Column) -> Column:
    """White space of any kind to single blanks, trimmed."""
    return F.trim(F.regexp_replace(v, r"[\s\u00a0\u2007\u202f]+", " "))


def not_given(v: Column) -> Column:
    """True for null, empty and placeholder values (NA, N/A, NIL., X…, -, AMB.)."""
    t = F.upper(tidy(v))
    return v.isNull() | t.isin("", "NA", "N/A", "N.A.", "NIL", "NIL.", "-", "--", "AMB", "AMB.") | t.rlike(r"^X+([.,]X+)?( .*)?$")


def number_text(v: Column) -> Column:
    return F.regexp_extract(tidy(v), r"[-+]?\d+(?:[.,]\d+)*", 0)


def number(v: Column) -> Column:
    """First number. A comma before exactly three digits groups thousands, any other comma is a decimal mark."""
    plain = F.regexp_replace(F.regexp_replace(number_text(v), r",(?=\d{3}(?!\d))", ""), ",", ".")
    return plain.try_cast("double")


def unit_key(u: Column) -> Column:
    """Spelling of a unit without case, blanks, dots, brackets, degree signs and side remarks."""
    t = F.lower(tidy(u))
    t = F.regexp_replace(t, r"\(?\b(max|min|approx|ca|note ?\d*)\b\.?\)?|\bsee .*$", " ")
    t = F.regexp_replace(F.regexp_replace(t, "²", "2"), "''|”|″", '"')
    t = F.regexp_replace(t, r"deg(?=\.? ?[cfk]\b)", "")
    return F.regexp_replace(t, r"[^a-z0-9/\"%]+", "")


def unit_beside(v: Column) -> Column:
    """Unit spelling after the first number, '' where there is none."""
    return unit_key(F.regexp_extract(tidy(v), r"[-+]?\d+(?:[.,]\d+)*(.*)$", 1))


def remark_unit(remarks: Column, side: str, quantity: Column) -> Column:
    """Unit that the remarks state for one side ('' if none); a remark on another quantity does not count."""
    part = F.regexp_extract(remarks, rf"(?i)(?:\bunit on {side}\s*:\s*|\b{side}\b[^;:]*?\b(?:in|reads|is|are)\s+)([^;]+)", 1)
    about = F.lower(F.regexp_extract(remarks, rf"(?i)\b{side}\s+(pressure|temperature|thickness|length)", 1))
    about = F.when(about == "thickness", "length").otherwise(about)
    return F.coalesce(F.when((about == "") | (about == quantity), unit_key(part)), F.lit(""))


def quantity_of(field: Column) -> Column:
    """pressure, temperature or length of a field's name; null for fields that hold no such quantity."""
    f = F.lower(field)
    return (
        F.when(f.contains("pressure"), "pressure")
        .when(f.contains("temperature"), "temperature")
        .when(f.rlike("thickness|allowance"), "length")
    )
