"""Matching records without a common key (problem 3): probabilistic record linkage.

Rows of both tables are read into features (piping class, kind, nominal sizes, material, kind
by type code) and reduced to distinct descriptions with their number of rows, so that hot
groups of alike rows are compared once. Two blocking passes bring candidates together;
agreement levels are counted per pattern; expectation-maximisation over the patterns estimates
match probabilities against those of chance; the posterior is the confidence and decides alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from . import parts

FEATURES = ["cls", "kind", "size", "mat", "typed"]
FIELDS = ["k", "s", "m", "t"]
#: Posterior from which a pair is a match.
ACCEPT = 2 / 3
#: Levels of agreement: 2 equal, 1 in part, 0 different, 3 not known; of the type code where no kind is described: 5 equal, 4 different.
LEVELS, UNKNOWN = 6, 3
#: Least share of agreement among known values of records of one component, by field and level. It tells the two classes
#: apart where fields are independent given the block (see `fit`).
AGREE_FLOOR = {(0, 2): 0.97, (1, 2): 0.97, (2, 2): 0.9, (3, 5): 0.8}


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            kind = parts.kind(r.description)
            if r.side == "item":
                size = tuple(sorted({d for c in (r.p1, r.p2, r.p3) for d in parts.sizes(c, None)}, reverse=True)) or parts.sizes(None, r.description, kind)
            else:
                size = parts.sizes(r.p1, r.description, kind)
            rows.append((r.id, r.cls, kind, "x".join(map(str, size)), parts.material(r.material, r.description, kind), parts.kind(r.type).split(" ")[0]))
        yield pd.DataFrame(rows, columns=["id", *FEATURES])


def piping_class(code: str, fallback: str, segment: int, sep: str) -> Column:
    """First five letters and digits of a class code; of a part of the fallback where the code is missing or a placeholder."""
    clean = lambda c: F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")
    own, other = clean(F.col(code)), clean(F.get(F.split(F.col(fallback), sep), F.lit(segment)))
    return F.when(F.length(own) >= 5, F.left(own, F.lit(5))).when(F.length(other) >= 5, F.left(other, F.lit(5))).otherwise("")


def _side(df: DataFrame, side: str, cls: Column, type_: str, sizes: list[str]) -> DataFrame:
    """(id, FEATURES, key) of every row, '' where it does not tell; a digest of 128 bits stands for the features in joins.

    Whole texts differ nearly from row to row, so they are not grouped before they are read: words and texts met before
    come from the readers' caches.
    """
    p = [F.col(c).cast("string") for c in sizes] + [F.lit(None).cast("string")] * (3 - len(sizes))
    src = df.select(F.col("id").cast("bigint").alias("id"), F.lit(side).alias("side"), cls.alias("cls"), F.col(type_).cast("string").alias("type"), "description", "material", *[c.alias(f"p{i + 1}") for i, c in enumerate(p)])
    read = src.mapInPandas(_read, "id bigint, cls string, kind string, size string, mat string, typed string")
    return materialise(read.withColumn("key", F.unhex(F.md5(F.concat_ws("|", *FEATURES)))), side)


def described(side: DataFrame) -> DataFrame:
    """Distinct descriptions with their number of rows."""
    return side.groupBy("key", *FEATURES).agg(F.count("*").alias("n"))


def item_side(items: DataFrame) -> DataFrame:
    return _side(items, "item", piping_class("spec_code", "reference", 1, "/"), "type", ["size_p1", "size_p2", "size_p3"])


def bom_side(bom: DataFrame) -> DataFrame:
    return _side(bom, "bom", piping_class("spec_class", "line_number", 2, "-"), "component_type", ["size"])


def _levels() -> list[Column]:
    family = lambda c: F.split(c, " ")[0]
    unknown = (F.col("l_kind") == "") | (F.col("r_kind") == "")
    k = F.when(unknown, 3).when((F.col("l_kind") == F.col("r_kind")) & ~F.col("l_kind").contains("?"), 2).when(family(F.col("l_kind")) == family(F.col("r_kind")), 1).otherwise(0)
    s = F.when((F.col("l_size") == "") | (F.col("r_size") == ""), 3).when(F.col("l_size") == F.col("r_size"), 2).when(F.split("l_size", "x")[0] == F.split("r_size", "x")[0], 1).otherwise(0)
    m = F.when((F.col("l_mat") == "") | (F.col("r_mat") == ""), 3).when(F.col("l_mat") == F.col("r_mat"), 2).otherwise(0)
    # The type code says again, less reliably, what the described kind says: its weight depends on whether a kind is described.
    t = F.when((F.col("l_typed") == "") | (F.col("r_typed") == ""), 3).when(F.col("l_typed") == F.col("r_typed"), F.when(unknown, 5).otherwise(2)).otherwise(F.when(unknown, 4).otherwise(0))
    return [k.alias("k"), s.alias("s"), m.alias("m"), t.alias("t")]


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of distinct descriptions from both blocking passes with their levels and row counts."""
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in ("key", *FEATURES)], F.col("n").alias("l_n"))  # noqa: E741
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in ("key", *FEATURES)], F.col("n").alias("r_n"))
    by_kind = l.join(r, (F.col("l_cls") == F.col("r_cls")) & (F.col("l_kind") == F.col("r_kind"))).filter("l_cls <> '' and l_kind <> ''")
    by_size = l.join(r, (F.col("l_cls") == F.col("r_cls")) & (F.col("l_size") == F.col("r_size"))).filter("l_cls <> '' and l_size <> '' and (l_kind <> r_kind or l_kind = '')")
    return by_kind.unionByName(by_size).select("l_key", "r_key", "l_n", "r_n", *_levels())


def chance(left: DataFrame, right: DataFrame) -> np.ndarray:
    """Probabilities of the levels of each field for two rows drawn at random, from the fields' marginal counts.

    One aggregate over the distinct values of all fields gives the shares of equal values, whole or by their first
    part; only a row per field reaches the driver.
    """
    first = {"kind": " ", "size": "x"}
    marks = [(c, F.col(c)) for c in FEATURES[1:]] + [(f"{c} first", F.split(c, s)[0]) for c, s in first.items()]
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("f"), F.when(F.col(n.split(" ")[0]) != "", v).alias("v")) for n, v in marks]))
    zero = F.lit(0).cast("bigint")
    sides = left.select(F.col("n").alias("a"), zero.alias("b"), each).unionByName(right.select(zero.alias("a"), F.col("n").alias("b"), each))
    values = sides.filter("v is not null").groupBy("f", "v").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    share = {r["f"]: r["p"] or 0.0 for r in values.groupBy("f").agg(F.try_divide(F.sum(F.col("a") * F.col("b")), F.sum("a") * F.sum("b")).alias("p")).toLocalIterator()}
    u = np.zeros((len(FIELDS), LEVELS))
    for i, c in enumerate(FEATURES[1:]):
        u[i, 2] = share.get(c, 0.0)
        u[i, 1] = max(0.0, share.get(f"{c} first", u[i, 2]) - u[i, 2])
        u[i, 0] = max(0.0, 1 - u[i, 1] - u[i, 2])
    u[3, 4], u[3, 5] = u[3, 0], u[3, 2]
    return np.maximum(u, 1e-4)


def _hot(x: np.ndarray) -> np.ndarray:
    hot = np.stack([x == v for v in range(LEVELS)], axis=2).astype(float)
    hot[:, :, UNKNOWN] = 0  # an unknown value tells nothing
    return hot


def _constrain(c: np.ndarray, use: list[int], floors: dict) -> np.ndarray:
    """Counts to shares within each set of levels that exclude each other, agreement at its floor at least."""
    for row, f in enumerate(use):
        for group, agree in (((0, 1, 2), 2), ((4, 5), 5)):
            g = list(group)
            c[row, g] = c[row, g] / max(c[row, g].sum(), 1e-12)
            floor = floors.get((f, agree), 0.0)
            if c[row, agree] < floor:
                rest = [v for v in g if v != agree]
                c[row, rest] *= (1 - floor) / max(c[row, rest].sum(), 1e-9)
                c[row, agree] = floor
    c[:, UNKNOWN] = 0
    return c


def _em(x: np.ndarray, w: np.ndarray, u: np.ndarray, m: np.ndarray, use: list[int], floors: dict, rounds: int = 500) -> float:
    """Estimate rows ``use`` of ``m`` in place and return the share of matches; ``u`` is known."""
    hot = _hot(x)[:, use]
    prior, last = 0.2, -1.0
    for _ in range(rounds):
        ratio = np.einsum("pfl,fl->p", hot, np.log(np.maximum(m[use], 1e-6)) - np.log(np.maximum(u[use], 1e-6)))
        post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + ratio, -60, 60)))
        m[use] = _constrain(np.tensordot(w * post, hot, axes=(0, 0)) + 0.01, use, floors)
        prior = float(np.clip((w * post).sum() / w.sum(), 1e-6, 1 - 1e-6))
        if abs(prior - last) < 1e-9:
            break
        last = prior
    return prior


def fit(patterns: pd.DataFrame, u: np.ndarray, floors: dict = AGREE_FLOOR) -> pd.DataFrame:
    """Adds ``confidence`` to the counted agreement patterns (FIELDS and w).

    Each blocking pass fixes one field, so that field is left out of its expectation-maximisation: the pass by kind
    estimates sizes, material and type, the pass by size estimates the kind and the type where no kind is described.
    Among pairs of one kind the type code's chance levels are those of pairs that differ in size or material. ``floors``
    bound the shares of agreement among matches from below.
    """
    if patterns.empty:
        return patterns.assign(confidence=np.zeros(0))
    x, w, u = patterns[FIELDS].to_numpy(), patterns["w"].to_numpy(dtype=float), u.copy()
    m = np.array([[0.03, 0.07, 0.9, 0.0, 0.5, 0.5], [0.05, 0.05, 0.9, 0.0, 0.5, 0.5], [0.1, 0.0, 0.9, 0.0, 0.5, 0.5], [0.2, 0.0, 0.8, 0.0, 0.2, 0.8]])
    by_kind, by_size = x[:, 0] == 2, x[:, 1] == 2
    other = by_kind & ((x[:, 1] == 0) | (x[:, 2] == 0))
    seen = np.array([w[other & (x[:, 3] == v)].sum() + 0.5 for v in (0, 2)])
    u[3, [0, 2]] = seen / seen.sum()
    share = 0.2
    if by_kind.any():
        share = _em(x[by_kind], w[by_kind], u, m, [1, 2, 3], floors)
    if (by_size & ~by_kind).any():
        kept = m.copy()
        _em(x[by_size], w[by_size], u, m, [0, 2, 3], floors)
        m[1:3] = kept[1:3]
        m[3, :3] = kept[3, :3]
    base = np.log(share / (1 - share)) - np.log(max(m[0, 2], 1e-6) / max(u[0, 2], 1e-6))
    ratio = np.einsum("pfl,fl->p", _hot(x), np.log(np.maximum(m, 1e-6)) - np.log(np.maximum(u, 1e-6)))
    return patterns.assign(confidence=1 / (1 + np.exp(-np.clip(base + ratio, -60, 60))))


@dataclass
class Links:
    """``pairs``: (item_id, bom_id, confidence); ``classes``: one row per pair of descriptions that match, with the rows
    of either side; ``patterns``: levels, pairs of rows and confidence of each pattern."""

    pairs: DataFrame
    classes: DataFrame
    patterns: pd.DataFrame


def link(items: DataFrame, bom: DataFrame, accept: float = ACCEPT) -> Links:
    """Pairs of rows that describe the same component, each with its confidence.

    A pair is kept if its posterior is ``accept`` or more. Rows that tell no class, or neither kind nor size, match
    nothing; a row without a kind can match by class, sizes, material and type code together; repeated rows give a pair
    each; empty tables give no pairs. Further columns are ignored.
    """
    left_side, right_side = item_side(items), bom_side(bom)
    left, right = described(left_side), described(right_side)
    cand = materialise(candidates(left, right), "candidates")
    # At most 4 levels of 3 fields and 6 of the type code: 384 rows.
    counted = cand.groupBy(*FIELDS).agg(F.sum(F.col("l_n") * F.col("r_n")).cast("double").alias("w")).orderBy(*FIELDS).toPandas()
    patterns = fit(counted, chance(left, right))
    spark = items.sparkSession
    good = [(*map(int, r[:4]), float(r[5])) for r in patterns.itertuples(index=False) if r[5] >= accept]
    scored = spark.createDataFrame(good, "k int, s int, m int, t int, confidence double")
    classes = cand.join(F.broadcast(scored), FIELDS).select("l_key", "r_key", "l_n", "r_n", *FIELDS, "confidence")
    rows = lambda side, name, key: side.select(F.col("id").alias(name), F.col("key").alias(key))
    pairs = classes.join(rows(left_side, "item_id", "l_key"), "l_key").join(rows(right_side, "bom_id", "r_key"), "r_key").select("item_id", "bom_id", "confidence")
    shown = lambda side, key, mark: side.select(F.col("key").alias(key), *[F.col(c).alias(f"{mark}_{c}") for c in FEATURES])
    told = classes.join(shown(left, "l_key", "item"), "l_key").join(shown(right, "r_key", "bom"), "r_key")
    return Links(pairs, told.select(*[f"{s}_{c}" for s in ("item", "bom") for c in FEATURES], F.col("l_n").alias("items"), F.col("r_n").alias("bom_rows"), "confidence"), patterns)
