"""Routing and fittings of a line on the isometrics beside the diagrams; legends and the parts they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as T
from . import gates as G

# Categories that diagrams draw, in the order they are shown.
DRAWN = ("reducers", "spectacle blinds", "expansion joints", "caps", "couplings", "other fittings")
# End of fixed values.


def _count(q: str = "quantity") -> Column:
    return F.sum(F.coalesce(T.number(F.col(q)), F.lit(1.0)))


def tally(df: DataFrame, keys: list[str], component: Column, description: Column, name: str) -> DataFrame:
    """(keys, name): counts by fitting category as a map; a missing quantity is one."""
    c = df.withColumn("_c", K.fitting(component, description)).filter("_c is not null").groupBy(*keys, "_c").agg(_count().alias("_n"))
    return c.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_c", "_n"))).alias(name))


def routing(lines: DataFrame, bom: DataFrame, pid_lines: DataFrame, valves: DataFrame, fittings: DataFrame) -> DataFrame:
    """(project_id, document_id, k, field, iso_value, pid_value, status) of the ends, slope, valves and drawn fittings of every line.

    lines: project_id, document_id, k, from_location, to_location, slope. bom: document_id, k, component_type, description,
    quantity. pid_lines: project_id, k, id, from_equipment, to_equipment, slope. valves: project_id, k, quantity. fittings:
    project_id, k, fitting_type, size, quantity. Ends are compared where the diagrams state any and the isometric's is no
    reference to another drawing; slopes where the diagrams state one; valves where they draw any. Drawn fittings are a
    minimum; categories that neither side has are left out, those that only the isometric has are "iso only".
    """
    side, pid = ["document_id", "k"], ["project_id", "k"]
    distinct = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(~T.blank(c), F.struct("id", c.alias("v"))))), lambda s: s["v"]))
    drawn = pid_lines.groupBy(*pid).agg(F.count("*").alias("pid_lines"), distinct(F.col("from_equipment")).alias("froms"), distinct(F.col("to_equipment")).alias("tos"), distinct(T.slope(F.col("slope"))).alias("slopes"))
    text = F.concat(F.coalesce("fitting_type", F.lit("")), F.lit(" "), F.coalesce("size", F.lit("")))
    j = lines.join(tally(bom, side, F.col("component_type"), F.col("description"), "iso"), side, "left").join(drawn, pid, "left")
    j = j.join(valves.groupBy(*pid).agg(_count().alias("pid_valves")), pid, "left").join(tally(fittings, pid, F.col("fitting_type"), text, "pid"), pid, "left")
    none = F.array().cast("array<string>")
    j = j.withColumns({c: F.coalesce(c, none) for c in ("froms", "tos", "slopes")})
    ends = F.transform(F.concat("froms", "tos"), T.endpoint)
    joined = lambda a: T.or_null(F.array_join(a, " / "))
    whole = lambda n: F.when(n == F.floor(n), n.cast("bigint").cast("string")).otherwise(F.round(n, 6).cast("string"))
    row = lambda field, a, b, status: F.struct(F.lit(field).alias("field"), a.alias("iso_value"), b.alias("pid_value"), status.alias("status"))

    def route(field: str, v: Column, listed: Column) -> Column:
        status = F.when(T.blank(v) | (F.size(ends) == 0) | G.continuation(v), "not compared").when(G.at_endpoint(v, ends), "match").otherwise("mismatch")
        return row(field, T.stated(v), joined(listed), status)

    slope = T.slope(T.stated(F.col("slope")))
    at = lambda m, c: F.coalesce(F.try_element_at(m, F.lit(c)), F.lit(0.0))
    iso_valves, pid_valves = at(F.col("iso"), "valves"), F.coalesce("pid_valves", F.lit(0.0))
    rows = [
        route("Route from", F.col("from_location"), F.col("froms")), route("Route to", F.col("to_location"), F.col("tos")),
        row("Slope", slope, joined(F.col("slopes")), F.when(F.size("slopes") == 0, "not compared").when(F.coalesce(F.array_contains("slopes", slope), F.lit(False)), "match").otherwise("mismatch")),
        row("Valves", whole(iso_valves), F.when(F.col("pid_lines") > 0, whole(pid_valves)), F.when(pid_valves == 0, "not compared").when(iso_valves >= pid_valves, "match").otherwise("mismatch")),
    ]
    for c in DRAWN:
        a, b = at(F.col("iso"), c), at(F.col("pid"), c)
        status = F.when(b == 0, "iso only").when(a >= b, "match").otherwise("mismatch")
        rows.append(F.when((a > 0) | (b > 0), row(c.capitalize(), whole(a), F.when(b > 0, F.concat(whole(b), F.lit(" drawn (min)"))), status)))
    return j.select("project_id", "document_id", "k", F.inline(F.array_compact(F.array(*rows))))


def legend_lines(items: DataFrame) -> DataFrame:
    """(category, lines): what a legend defines, by category, in the order of ids; without a category it is general.

    items: id, symbol, meaning, category, symbol_shape, applies_to, implied_components.
    """
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    line = F.concat("symbol", F.lit(" = "), F.coalesce("meaning", F.lit("")), F.when(some("symbol_shape"), F.concat(F.lit(" [drawn as: "), "symbol_shape", F.lit("]"))).otherwise(""),
                    F.when(some("implied_components"), F.concat(F.lit(" [applies to: "), F.coalesce("applies_to", F.lit("?")), F.lit("; implies on ISO: "), "implied_components", F.lit("]"))).otherwise(""))
    g = items.groupBy(F.when(some("category"), F.col("category")).otherwise("general").alias("category"))
    return g.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("t")))), lambda s: s["t"]), "\n").alias("lines"))


def newest_legend(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Legend items of the project's newest legend document where it has several (items: project_id, document_id)."""
    held = items.select("project_id", "document_id").distinct().join(documents.select(F.col("id").alias("document_id"), "uploaded_at"), "document_id", "left")
    newest = held.groupBy("project_id").agg(F.max_by("document_id", F.struct(F.coalesce("uploaded_at", F.lit("1900-01-01").cast("timestamp")), "document_id")).alias("document_id"))
    return items.join(newest, ["project_id", "document_id"], "left_semi")


def typicals(instruments: DataFrame, items: DataFrame) -> DataFrame:
    """(id, typical_id): the first legend item with implied parts that applies to an instrument's letters.

    instruments: id, tag_number. items: id, applies_to ("PI/TI"), implied_components.
    """
    t = items.filter(T.trimmed(F.col("implied_components")) != "").select(F.col("id").alias("typical_id"), F.explode(F.split(F.upper("applies_to"), "/")).alias("a")).select("typical_id", T.trimmed(F.col("a")).alias("letters"))
    first = t.groupBy("letters").agg(F.min("typical_id").alias("typical_id"))
    letters = T.or_null(F.regexp_extract(T.tag_key(F.col("tag_number")), "^([A-Z]+)", 1))
    return instruments.withColumn("letters", letters).join(first, "letters").select("id", "typical_id")


def named_in(tag: Column, texts: Column) -> Column:
    """Whether any of the texts holds a tag."""
    return F.exists(texts, lambda t: F.coalesce(T.tag_key(t).contains(T.tag_key(tag)), F.lit(False)))


def supports_listed(description: Column, texts: Column) -> Column:
    """Whether any support type that a description names stands in any of the texts; null if it names none."""
    types = F.regexp_extract_all(description, F.lit(G.SUPPORT_TYPE), F.lit(0))
    return F.when(F.size(types) > 0, F.exists(types, lambda t: named_in(t, texts)))


def row_by_code(rows: Column, code: Column) -> Column:
    """First row of array<struct<item_code, valve_index_code, ...>> of an item code; a row's own item code comes first."""
    fits = F.filter(rows, lambda r: T.tag_key(F.coalesce(r["item_code"], r["valve_index_code"])) == T.tag_key(code))
    return F.when(code != "", F.get(fits, F.lit(0)))
