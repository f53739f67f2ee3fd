"""Text functions on columns: keys, placeholders, slopes, line numbers, classes, ratings, tokens.

All are built-in expressions, so they stay in generated code. ``\\s`` in a Java pattern leaves
out the no-break space, hence WS.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Pressure classes, placeholder words, token patterns.
RATINGS = (150, 300, 400, 600, 900, 1500, 2500)
PLACEHOLDERS = ("NA", "N/A", "NIL", "NIL.", "-")
PLACEHOLDER_TOKEN = r"^X+([.,]X+)?$"
SLOPE = r"(?i)(\d+(?:\.\d+)?)\s*(?::|/|\bin\b)\s*(\d+(?:\.\d+)?)"
RATING = r"(\d{3,4})\s*(?:#|LBS?\b|RF\b|CLASS\b)"
END_TYPE = r"(?i)\b(?:BW|SW|WN|THRD|THD|LJ|SO|PE|BE|TE|FE|RF)\b"
STANDARDS = (r"(?i)\bB\s?\d{1,3}\.\d{1,3}(?:\.\d+)?\b", r"(?i)\bAPI\s?\d{3,4}[A-Z]?\b", r"(?i)\bMSS[- ]?SP[- ]?\d+\b")
SCHEDULE = r"(?i)\bSCH(?:EDULE)?\.?\s?(\d+S?|XXS|XS|STD)\b"
CLASS_RATING = r"(?i)\bCLASS\.?\s?(\d{2,4})\b|\b(\d{2,4})\s?#"
GRADE = r"(?i)\b[AB]\s?\d{3}[A-Z]?\b"
WELD_TAG = r"(?i)\b(?:BW|SW|FW)\s*0*\d+\b"
COORDINATE = r"(?i)\b[EN]\d{6,}\b|\bEL\s*[+-]?\d{5,}\b"
# End of fixed values.


def trimmed(v: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(v, f"^{WS}+|{WS}+$", "")


def or_null(v: Column) -> Column:
    return F.when(v != "", v)


def tag_key(v: Column, strip: str | None = None) -> Column:
    """Join key of a tag: upper case, trimmed; ``strip`` removes a pattern first (not done at ingest)."""
    return F.upper(trimmed(F.regexp_replace(v, strip, "") if strip else v))


#: Hyphens and white space, for callers that compare keys more loosely.
LOOSE = rf"[-]|{WS}"


def blank(v: Column) -> Column:
    """Null, empty or a placeholder; a first word of only X counts as one."""
    return v.isNull() | placeholder(trimmed(v))


def placeholder(t: Column) -> Column:
    """Whether a trimmed text is empty or a placeholder."""
    words = "|".join(w.replace(".", r"\.") for w in PLACEHOLDERS)
    return F.upper(t).rlike(rf"(?s)^(|{words}|{PLACEHOLDER_TOKEN[1:-1]}({WS}.*)?)$")


def stated(v: Column) -> Column:
    """The value, null where it is blank."""
    return F.when(~blank(v), v)


def slope(v: Column) -> Column:
    """First ratio as a:b, other texts trimmed, blank as null."""
    t = trimmed(v)
    a, b = F.regexp_extract(t, SLOPE, 1), F.regexp_extract(t, SLOPE, 2)
    return F.when(t == "", None).when(a != "", F.concat(a, F.lit(":"), b)).otherwise(t)


def line_parts(v: Column) -> Column:
    """struct<size, size_mm, service, spec_class, unique_no, insulation_code, heat_trace>, null if undecodable."""
    seg = F.filter(F.transform(F.split(trimmed(v), "-"), trimmed), lambda s: s != "")
    names = ["service", "spec_class", "unique_no", "insulation_code", "heat_trace"]
    parts = F.struct(F.concat(seg[0], F.lit(" mm")).alias("size"), seg[0].try_cast("double").alias("size_mm"), *[F.get(seg, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    return F.when((F.size(seg) >= 4) & seg[0].rlike(r"^[0-9]+$"), parts)


def completed_line(number: Column, attrs: dict[str, Column]) -> dict[str, Column]:
    """Title-block fields with blanks filled from the line number; a bare size equal to the decoded one gets its unit."""
    d = line_parts(number)
    out = {k: F.when(d.isNotNull() & blank(attrs[k]) & d[k].isNotNull(), d[k]).otherwise(attrs[k]) for k in ("service", "spec_class", "unique_no", "heat_trace") if k in attrs}
    s = trimmed(F.coalesce(attrs["size"], F.lit("")))
    same = s.rlike(r"^\d+(\.\d+)?$") & (s.try_cast("double") == d["size_mm"])
    out["size"] = F.when(d.isNotNull() & blank(s), d["size"]).when(d.isNotNull() & same, F.concat(s, F.lit(" mm"))).otherwise(attrs["size"])
    if "insul_spec" in attrs:
        out["insul_spec"] = F.when(d.isNotNull() & blank(attrs["insul_spec"]) & d["insulation_code"].isNotNull(), d["insulation_code"]).otherwise(attrs["insul_spec"])
    return out


def number(v: Column) -> Column:
    """First number with commas taken out; null for blanks."""
    return F.when(~blank(v), F.regexp_extract(F.regexp_replace(v, ",", ""), r"-?\d+(\.\d+)?", 0).try_cast("double"))


def unit(v: Column) -> Column:
    """Text after a leading number, lower case without white space; null if there is none."""
    rest = F.regexp_extract(trimmed(v), rf"^-?[\d.,]+{WS}*(.*)$", 1)
    return or_null(F.regexp_replace(F.lower(rest), f"{WS}+", ""))


def class_code(v: Column) -> Column:
    """Upper-case code without a spurious 1 at its end."""
    return F.regexp_replace(F.upper(trimmed(v)), r"^([A-Z]+\d+[A-Z])1$", "$1")


def class_stem(v: Column) -> Column:
    """Class without its suffix, null for blanks."""
    t = F.upper(trimmed(v))
    stem = F.regexp_extract(t, r"^([A-Z]{2}\d{2}[A-Z]?)(?:[-\s].*)?$", 1)
    return F.when(~blank(v), F.when(stem != "", stem).otherwise(t))


def bom_class(v: Column) -> Column:
    return class_code(class_stem(v))


def rating(v: Column) -> Column:
    """Pressure class that a text names, null if it is none of the known ones."""
    n = F.regexp_extract(F.upper(v), RATING, 1).try_cast("int")
    return F.when(n.isin(*RATINGS), n)


def tells_class(v: Column) -> Column:
    return ~F.lower(v).contains("orifice")


def class_by_rating(text: Column, specs: Column) -> Column:
    """Of array<struct<spec_class, rating>> the one class with the text's rating; null if none or several have it."""
    hits = F.filter(specs, lambda s: s["rating"] == rating(text))
    return F.when((F.size(specs) >= 2) & tells_class(text) & (F.size(hits) == 1), hits[0]["spec_class"])


def tokens(v: Column, pattern: str) -> Column:
    """Distinct matches in order, upper case, without white space."""
    return F.array_distinct(F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), lambda t: F.upper(F.regexp_replace(t, r"\s+", ""))))


def end_type(v: Column) -> Column:
    """First end type that is not a face, else the first."""
    t = tokens(v, END_TYPE)
    return F.coalesce(F.get(F.filter(t, lambda x: x != "RF"), F.lit(0)), F.get(t, F.lit(0)))


def standards(v: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*[tokens(v, p) for p in STANDARDS])))


def schedule(v: Column) -> Column:
    return or_null(F.upper(F.regexp_extract(v, SCHEDULE, 1)))


def class_rating(v: Column) -> Column:
    return F.coalesce(or_null(F.regexp_extract(v, CLASS_RATING, 1)), or_null(F.regexp_extract(v, CLASS_RATING, 2)))


def trailing_number(v: Column) -> Column:
    """Digits at the end without leading zeros, else the trimmed text."""
    d = F.regexp_extract(v, r"(\d+)\s*$", 1)
    return F.when(d != "", d.try_cast("bigint").cast("string")).otherwise(trimmed(v))


def tag_parts(v: Column) -> Column:
    """struct<prefix, num> of a tag such as SW07; null if it is no prefix and number."""
    t = F.regexp_replace(v, r"\s+", "")
    p = F.regexp_extract(t, r"^([A-Za-z]+)0*(\d+)$", 1)
    return F.when(p != "", F.struct(F.upper(p).alias("prefix"), F.regexp_extract(t, r"^([A-Za-z]+)0*(\d+)$", 2).try_cast("bigint").alias("num")))


def endpoint(v: Column) -> Column:
    return F.regexp_replace(tag_key(F.coalesce(v, F.lit(""))), r"[-\s]", "")


def cell(v: Column) -> Column:
    """Lines of a cell trimmed and joined by a slash, empty as null."""
    lines = F.filter(F.transform(F.split(v, r"\r?\n"), trimmed), lambda x: x != "")
    return or_null(F.array_join(lines, " / "))


def elevation(v: Column) -> Column:
    """Number of an elevation without its leading plus; null for texts that are none."""
    n = F.regexp_replace(trimmed(v), r"^\+", "").try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def axis(v: Column) -> Column:
    """e, n or el in lower case, null for anything else."""
    a = F.lower(trimmed(v))
    return F.when(a.isin("e", "n", "el"), a)


def stage_and_field(code: Column) -> Column:
    """struct<stage, field> of a finding's code, cut at its first dot."""
    return F.struct(F.regexp_extract(code, r"^([^.]*)", 1).alias("stage"), F.regexp_extract(code, r"^[^.]*\.(.*)$", 1).alias("field"))


def joined_text(*parts: Column) -> Column:
    """Stated parts joined by a comma, a dash where there is none."""
    return F.coalesce(or_null(F.concat_ws(", ", *[or_null(trimmed(p)) for p in parts])), F.lit("-"))
