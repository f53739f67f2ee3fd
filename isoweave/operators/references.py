"""References to records that do not exist (problem 7).

Keys of all relations live in one key space, cut into ranges of their 64-bit
hash, so the ranges are even whatever the keys look like. Parents are reduced
to distinct keys before they move, and stored per range as one sorted array.
References are probed in batches by binary search; equal hashes are settled by
comparing the keys themselves. Ranges in which many references crowd (one
missing parent may be cited by a third of all rows) are split over several
probe groups, to each of which the range's parents are copied.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import guarded_broadcast, materialise

#: References that one probe group holds at most on average, and parents that a range holds on average.
GROUP_ROWS, RANGE_PARENTS = 200_000, 200_000


def last_number(v: Column) -> Column:
    """Digits of the last number in a text without leading zeros; null if it has none."""
    d = F.regexp_extract(v, r"(\d+)\D*$", 1)
    return F.when(d != "", F.regexp_replace(d, r"^0+(?=\d)", ""))


def given(v: Column) -> Column:
    """Not blank, -, N/A, NA, XX or NIL by its letters and digits, so ``NA,`` and ``- -`` are none either."""
    return v.isNotNull() & ~F.upper(F.regexp_replace(v, "[^A-Za-z0-9]+", "")).isin("", "NA", "XX", "NIL")


def _probe(_: tuple, refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    out = refs.drop(columns=["range", "salt", "h", "key"])
    if refs.empty or parents.empty:
        return out
    ph, pk = parents["h"].to_numpy(), parents["key"].to_numpy(dtype=object)
    order = np.argsort(ph, kind="stable")
    ph, pk = ph[order], pk[order]
    h, k = refs["h"].to_numpy(), refs["key"].to_numpy(dtype=object)
    at = np.searchsorted(ph, h, side="left")
    found = np.zeros(len(h), dtype=bool)
    live = np.flatnonzero(at < len(ph))
    while live.size:  # more than one turn only where hashes collide
        live = live[ph[at[live]] == h[live]]
        hit = pk[at[live]] == k[live]
        found[live[hit]] = True
        live = live[~hit]
        at[live] += 1
        live = live[at[live] < len(ph)]
    return out[~found]


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``refs`` whose ``key`` is not in ``parents.key``, without that column.

    refs: ``key string`` and any further columns, which are returned. parents: ``key string``, repeats allowed.
    Defined cases: a null reference cites nothing and is no orphan; null parents are ignored; without parents every
    reference is an orphan; repeated references are each reported; names of further columns may be any but
    ``range``, ``salt``, ``h``, ``key``.
    """
    carried = [c for c in refs.columns if c != "key"]
    p = materialise(parents.select("key").filter(F.col("key").isNotNull()).distinct().withColumn("h", F.xxhash64("key")), "parents")
    r = refs.filter(F.col("key").isNotNull()).withColumn("h", F.xxhash64("key"))
    ranges = max(1, -(-p.count() // RANGE_PARENTS))
    ranges = max(ranges, refs.sparkSession.sparkContext.defaultParallelism)
    # hash order: the upper 31 bits, moved to 0 .. 2^31, scaled to the number of ranges
    upper = F.shiftright("h", 33) + F.lit(1 << 30)
    in_range = F.shiftright(upper * F.lit(ranges), 31).cast("int")
    crowd = materialise(
        r.groupBy(in_range.alias("range")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / GROUP_ROWS)).cast("int").alias("groups")), "crowd"
    )
    crowd = guarded_broadcast(crowd)  # one row per range
    refs_at = (
        r.withColumn("range", in_range)
        .join(crowd, "range")
        .withColumn("salt", F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in carried] or ["key"]), F.col("groups")).cast("int"))
        .drop("groups")
    )
    parents_at = p.withColumn("range", in_range).join(crowd, "range").select("range", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), "h", "key")
    schema = refs.select(*carried).schema
    return refs_at.groupBy("range", "salt").cogroup(parents_at.groupBy("range", "salt")).applyInPandas(_probe, schema)


def citations(tags: DataFrame, results: DataFrame, pages: DataFrame) -> DataFrame:
    """All references of the domain as (key, table_name, row_id, ref_field, created_at)."""
    parts = []
    for name, df in (("extracted_tags", tags), ("extraction_results", results), ("document_pages", pages)):
        when = F.col("created_at") if "created_at" in df.columns else F.lit(None).cast("timestamp")
        parts.append(df.select(F.concat(F.lit("D|"), "document_id").alias("key"), F.lit(name).alias("table_name"), F.col("id").cast("string").alias("row_id"), F.lit("document_id").alias("ref_field"), when.alias("created_at")))
    welds = tags.filter(F.col("tag_type") == "weld").select("id", "document_id", "created_at", F.from_json("attributes", "spool_no string, weld_list_id string").alias("a"))
    cited = welds.select(
        "id", "document_id", "created_at",
        F.inline(F.array(
            F.struct(F.lit("spool_no").alias("ref_field"), F.lit("spool").alias("kind"), F.col("a.spool_no").alias("v")),
            F.struct(F.lit("weld_list_id").alias("ref_field"), F.lit("weld_list_row").alias("kind"), F.col("a.weld_list_id").alias("v")),
        )),
    ).filter(given(F.col("v")))
    parts.append(cited.select(local_key("kind", "document_id", last_number(F.col("v"))), F.lit("extracted_tags").alias("table_name"), F.col("id").cast("string").alias("row_id"), "ref_field", "created_at"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def local_key(kind: str, document: str, number: Column) -> Column:
    # A citation without any number equals none: it gets a key that no parent has.
    return F.concat(F.col(kind), F.lit("|"), F.coalesce(F.col(document), F.lit("")), F.lit("|"), F.coalesce(number, F.lit("none"))).alias("key")


def targets(documents: DataFrame, tags: DataFrame) -> DataFrame:
    """All keys that the references of `citations` may cite."""
    named = tags.filter(F.col("tag_type").isin("spool", "weld_list_row")).withColumn("n", last_number(F.col("tag_number"))).filter(F.col("n").isNotNull())
    return documents.select(F.concat(F.lit("D|"), "id").alias("key")).unionByName(named.select(local_key("tag_type", "document_id", F.col("n"))))


def report(found: DataFrame) -> DataFrame:
    """Orphans counted per table, field and month (null where the row has no time)."""
    month = F.date_format("created_at", "yyyy-MM")
    return found.groupBy("table_name", "ref_field", month.alias("month")).agg(F.count("*").alias("orphans"))
