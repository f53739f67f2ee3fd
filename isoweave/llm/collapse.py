"""Duplicates hidden by formatting differences (problem 4).

Records are range-partitioned by (hash of their block, id), so that even one block
holding a third of all rows spreads evenly, turned into canonical records, sorted
externally inside each partition, and scanned once: adjacent rows with equal full
keys are one run. A run cut by a partition border leaves one fragment per partition;
fragments of the blocks at the borders are joined by key afterwards.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import guarded_broadcast, materialise

_DROP = bytes(i for i in range(256) if not chr(i).isascii() or not chr(i).isalnum())
SEP = "\x1f"


def plain(text: str) -> str:
    """ASCII letters and digits of a text, in lower case."""
    return text.encode("ascii", "ignore").translate(None, _DROP).lower().decode()


def _canonical(v: object) -> str:
    """Canonical text of a JSON value, '' where no letter or digit is left of it."""
    if v is None:
        return ""
    if isinstance(v, str):
        s = plain(v)
        return "s" + s if s else ""
    if isinstance(v, bool):
        return "b1" if v else "b0"
    if isinstance(v, (int, float)):
        return f"n{int(v)}" if v == v and abs(v) != float("inf") and v == int(v) else f"n{v!r}"
    if isinstance(v, dict):
        parts = [f"{json.dumps(k)}:{c}" for k, c in sorted((k, _canonical(x)) for k, x in v.items()) if c]
        return "{" + ",".join(parts) + "}" if parts else ""
    parts = [_canonical(x) for x in v]
    return "[" + ",".join(parts) + "]" if any(parts) else ""


def canonical_json(text: str | None) -> str:
    """Canonical form of a JSON bag; a text that cannot be read stands for itself, by letters and digits."""
    if text is None:
        return ""
    try:
        return _canonical(json.loads(text))
    except (ValueError, RecursionError):
        return "?" + plain(text)


def _canonise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [plain(t) if t is not None else "" for t in b["tag"]]
        bags = [canonical_json(a) for a in b["bag"]]
        keys = [f"{x}{SEP}{t}{SEP}{a}" for x, t, a in zip(b["block"], texts, bags)]
        yield pd.DataFrame({"bh": b["bh"], "key": keys, "id": b["id"]})


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one sorted partition to (pair: first_id, copy_id) and (fragment: key, first_id, n) rows."""
    head: int | None = None  # block hash at the start of the partition
    block: int | None = None
    key, first, n = None, 0, 0
    held: list[tuple[str, int]] = []  # fragments of the block at hand, wanted if it is the last one
    frag = lambda rows: pd.DataFrame({"first_id": [f for _, f in rows], "copy_id": pd.array([None] * len(rows), dtype="Int64"), "key": [k for k, _ in rows]})
    for b in batches:
        if b.empty:
            continue
        keys, ids, hs = b["key"].to_numpy(dtype=object), b["id"].to_numpy(), b["bh"].to_numpy()
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        new[0] = keys[0] != key
        starts = np.flatnonzero(new)
        at = np.cumsum(new) - 1  # -1: continues the run of the batch before
        firsts = np.where(at >= 0, ids[starts[np.maximum(at, 0)]] if len(starts) else first, first)
        copies = ~new
        if copies.any():
            yield pd.DataFrame({"first_id": firsts[copies], "copy_id": pd.array(ids[copies], dtype="Int64"), "key": pd.Series([None] * int(copies.sum()), dtype=object)})
        if head is None:
            head = hs[0]
        out = []
        for s in starts:
            if hs[s] != block:
                if block is not None and block == head:
                    out += held
                block, held = hs[s], []
            held.append((keys[s], ids[s]))
            if block == head and len(held) > 10_000:
                out, held = out + held, []
        if out:
            yield frag(out)
        key, first = keys[-1], firsts[-1]
    if held:
        yield frag(held)


def copies(df: DataFrame, block: list[Column], tag: Column, bag: Column, key: str = "id") -> DataFrame:
    """(first_id, copy_id): one row per row that says the same as an earlier one, first_id the smallest id of its group.

    block: columns that must be equal (null equals null). tag: compared by letters and digits (null is empty). bag:
    JSON text; keys in any order, texts by letters and digits, numbers as numbers, nested values likewise; a key that
    is null or has no letter or digit left is absent; a null or empty bag has no keys; an unreadable bag is compared
    as text. Rows repeated with the same id give one row each; an empty table gives an empty result; very long bags
    are kept whole.
    """
    name = F.concat_ws(SEP, *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in block])
    tag_key = F.lower(F.regexp_replace(F.coalesce(tag, F.lit("")), "[^A-Za-z0-9]", ""))
    rows = df.select(F.xxhash64(name, tag_key).alias("bh"), name.alias("block"), tag.alias("tag"), bag.alias("bag"), F.col(key).cast("bigint").alias("id"))
    spread = rows.repartitionByRange("bh", "id")
    keyed = spread.mapInPandas(_canonise, "bh bigint, key string, id bigint").sortWithinPartitions("bh", "key", "id")
    found = materialise(keyed.mapInPandas(_scan, "first_id bigint, copy_id bigint, key string"), "runs")
    pairs = found.filter(F.col("key").isNull()).select("first_id", "copy_id")
    frags = found.filter(F.col("key").isNotNull()).select("key", "first_id")
    # A key has at most one fragment per partition; blocks inside a partition have none at all.
    whole = frags.groupBy("key").agg(F.min("first_id").alias("whole_id"), F.count("*").alias("n")).filter("n > 1")
    moved = materialise(frags.join(whole, "key").filter("first_id <> whole_id").select("first_id", "whole_id"), "moved")
    joined = pairs.join(guarded_broadcast(moved), "first_id", "left").select(F.coalesce("whole_id", "first_id").alias("first_id"), "copy_id")
    return joined.unionByName(moved.select(F.col("whole_id").alias("first_id"), F.col("first_id").alias("copy_id")))


def collapse(df: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """The rows of ``df`` that represent their group, with ``copies``, the number of rows in it."""
    counts = found.groupBy("first_id").agg((F.count("*") + 1).alias("copies"))
    kept = df.join(found.select(F.col("copy_id").alias(key)), key, "left_anti")
    return kept.join(counts, kept[key] == counts["first_id"], "left").drop("first_id").withColumn("copies", F.coalesce("copies", F.lit(1)))


def tag_copies(tags: DataFrame) -> DataFrame:
    return copies(tags, [F.col("document_id"), F.col("tag_type"), F.col("source_page")], F.col("tag_number"), F.col("attributes"))
