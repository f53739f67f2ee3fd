"""Documents packed into token containers (problem 8).

Tokens are counted once per text with a public byte-level BPE. Only (doc_id, tokens)
moves on: bounded shards are filled best-fit decreasing, then improved by a swap-based
local search (move, one-for-one, two-for-one between underfull bins, each step raising the
sum of squared fills) until bins empty. Bins that stay underfull are dissolved and packed
again with those of other shards, until one shard holds them all or a round closes hardly
any bin, as where every document fills more than half a container.
"""

from __future__ import annotations

import base64
import math
import os
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the public split pattern that goes with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# End of fixed values.
#: Items of one shard; fill from which a bin is closed before the last round; steps of the search per underfull bin.
SHARD_ITEMS, CLOSE_AT, STEPS = 40_000, 0.985, 6
#: Share of the items that a round must place for another one to follow; below it bins are closed as they are.
PROGRESS = 0.05


@lru_cache(2)
def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens); null and empty texts have 0. The driver reads the vocabulary file, of about a megabyte, and ships it."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(shared.value).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [0 if t is None else len(enc(t)) for t in b["text"]]})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, tokens int")


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, best fit decreasing; sizes are 1 .. capacity."""
    bins = np.zeros(len(sizes), dtype=np.int64)
    free: list[tuple[int, int]] = []  # (room, bin), sorted
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        k = bisect_left(free, (s, -1))
        if k == len(free):
            room, b = capacity - s, n
            n += 1
        else:
            room, b = free.pop(k)
            room -= s
        bins[i] = b
        if room:
            insort(free, (room, b))
    return bins


def improve(sizes: np.ndarray, bins: np.ndarray, capacity: int, steps: int = STEPS) -> np.ndarray:
    """Local search over the underfull bins; never leaves a bin over capacity, never uses more bins."""
    bins = bins.copy()
    load = np.bincount(bins, weights=sizes).astype(np.int64)
    under = np.flatnonzero((load > 0) & (load < capacity))
    if len(under) < 2:
        return bins
    members: dict[int, list[int]] = {int(b): [] for b in under}
    pool = np.flatnonzero(np.isin(bins, under))
    for i in pool:
        members[int(bins[i])].append(int(i))
    s_pool = sizes[pool]
    place = {int(i): k for k, i in enumerate(pool)}
    b_pool = bins[pool]
    budget = steps * len(under)
    for src in under[np.argsort(load[under], kind="stable")]:
        src = int(src)
        moved = True
        while moved and members[src] and budget > 0:
            moved = False
            for take in _choices(members[src], sizes):
                budget -= 1
                size = int(sizes[list(take)].sum())
                room = capacity - load[b_pool]
                # whole move: the fullest other bin with room
                gain = np.where((b_pool != src) & (room >= size) & (load[b_pool] + size > load[src]), load[b_pool], -1)
                k = int(gain.argmax())
                if gain[k] > 0:
                    _shift(take, src, int(b_pool[k]), sizes, load, members, bins, b_pool, place)
                    moved = True
                    break
                # exchange for one smaller item of a bin that has room for the difference and ends fuller than this one
                diff = size - s_pool
                ok = (b_pool != src) & (diff > 0) & (diff <= room) & (load[b_pool] + diff > load[src])
                gain = np.where(ok, diff * (load[b_pool] + diff - load[src]), -1)
                k = int(gain.argmax())
                if gain[k] > 0:
                    dst, back = int(b_pool[k]), int(pool[k])
                    _shift(take, src, dst, sizes, load, members, bins, b_pool, place)
                    _shift((back,), dst, src, sizes, load, members, bins, b_pool, place)
                    moved = True
                    break
        if budget <= 0:
            break
    return bins


def _choices(items: list[int], sizes: np.ndarray) -> list[tuple[int, ...]]:
    """Single items from the largest, then pairs of the largest few."""
    order = sorted(items, key=lambda i: -int(sizes[i]))
    return [(i,) for i in order] + [(a, b) for k, a in enumerate(order[:4]) for b in order[k + 1 : 4]]


def _shift(take, src, dst, sizes, load, members, bins, b_pool, place) -> None:
    for i in take:
        members[src].remove(i)
        members[dst].append(i)
        bins[i] = dst
        b_pool[place[i]] = dst
        load[src] -= sizes[i]
        load[dst] += sizes[i]


def _packer(last: bool, round_: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece"], kind="stable")
        capacity = int(rows["capacity"].iloc[0])
        sizes = rows["tokens"].to_numpy(dtype=np.int64)
        bins = improve(sizes, fill(sizes, capacity), capacity)
        load = np.bincount(bins, weights=sizes)
        closed = np.ones(len(load), dtype=bool) if last else load >= CLOSE_AT * capacity
        names = [f"{key[0]}-{round_}-{key[1]}-{b}" for b in bins]
        return rows[["limit_id", "capacity", "doc_id", "piece", "tokens"]].assign(container=np.where(closed[bins], names, None))

    return pack


ITEMS = "limit_id int, capacity int, doc_id bigint, piece int, tokens int"


def pack(tokens: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """(limit_id, capacity, doc_id, piece, tokens, container) for every document and (limit_id, capacity).

    A document larger than a capacity is cut: its full pieces fill containers of their own, its rest is packed like
    any item. Documents of no token need no container and have none. Equal sizes are told apart by doc_id, so the
    result is the same for any order of the rows; a repeated doc_id is packed as often as it occurs.
    """
    spark = tokens.sparkSession
    base = materialise(tokens.filter("tokens > 0"), "tokens")
    lim = F.array(*[F.struct(F.lit(a).cast("int").alias("limit_id"), F.lit(b).cast("int").alias("capacity")) for a, b in limits])
    each = base.select("doc_id", "tokens", F.inline(lim))
    full = F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int")
    cut = each.filter("tokens > capacity").select("limit_id", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), F.col("capacity").alias("tokens"))
    done = cut.withColumn("container", F.concat_ws("-", "limit_id", F.lit("full"), "doc_id", "piece"))
    rest = each.select("limit_id", "capacity", "doc_id", F.when(F.col("tokens") > F.col("capacity"), full).otherwise(0).alias("piece"), (F.col("tokens") - full * F.col("capacity")).cast("int").alias("tokens"))
    n, before, parts, round_ = base.count(), None, [], 0
    while n:
        shards = max(1, math.ceil(n / SHARD_ITEMS))
        last = shards == 1 or (before is not None and n > before * (1 - PROGRESS))
        placed = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_)), F.lit(shards)).cast("int"))
        placed = materialise(placed.groupBy("limit_id", "shard").applyInPandas(_packer(last, round_), ITEMS + ", container string"), "packed")
        parts.append(placed.filter(F.col("container").isNotNull()))
        if last:
            break
        rest = placed.filter(F.col("container").isNull()).drop("container")
        n, before, round_ = rest.groupBy("limit_id").count().agg(F.max("count")).first()[0] or 0, n, round_ + 1
    for p in parts:
        done = done.unionByName(p)
    return done


def token_limits(size_limits: DataFrame) -> list[tuple[int, int]]:
    rows = size_limits.filter("unit = 'tokens'").orderBy("limit_id").select("limit_id", "capacity").toLocalIterator()
    return [(int(r["limit_id"]), int(r["capacity"])) for r in rows]
