"""Symbols in the vector paths of a page, as array kernels for grouped pandas (one page a group)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sizes in points.
CLOSED, RADIUS, ROUNDNESS = 0.5, (2.0, 20.0), 0.35
BOWTIE = (14.0, 26.0)
# End of fixed values.


def diamond(points: np.ndarray) -> tuple[int, float, float] | None:
    """(offset, x, y) of the first closed four-sided loop whose corners lie at one distance from their centre."""
    n = len(points)
    if n < 5:
        return None
    closed = np.flatnonzero(np.hypot(*(points[: n - 4] - points[4:]).T) <= CLOSED)
    for k in closed:
        corners = points[k : k + 4]
        centre = corners.mean(axis=0)
        r = np.hypot(*(corners - centre).T)
        if RADIUS[0] <= r.mean() <= RADIUS[1] and (np.abs(r - r.mean()) <= ROUNDNESS * r.mean()).all():
            return int(k), float(centre[0]), float(centre[1])
    return None


def _cross(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    side = lambda o, u, v: (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])
    return side(p, q, a) * side(p, q, b) < 0 and side(a, b, p) * side(a, b, q) < 0


def bowtie(points: np.ndarray) -> tuple[float, float] | None:
    """Centre of a closed six-point path with one pair of crossing sides and a diagonal of valve size."""
    if len(points) != 6 or np.hypot(*(points[0] - points[5])) > CLOSED:
        return None
    size = np.hypot(*(points.max(axis=0) - points.min(axis=0)))
    if not BOWTIE[0] <= size <= BOWTIE[1]:
        return None
    pairs = [(i, j) for i in range(5) for j in range(i + 2, 5) if not (i == 0 and j == 4)]
    hits = sum(_cross(points[i], points[i + 1], points[j], points[j + 1]) for i, j in pairs)
    if hits != 1:
        return None
    c = points[:5].mean(axis=0)
    return float(c[0]), float(c[1])


def symbols(paths: DataFrame) -> DataFrame:
    """(document_id, page_number, path_id, kind, x, y) of weld diamonds and valve bowties in paths of array<array<double>>.

    Row-wise, so paths need no grouping; empty and null paths give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, p, k, pts in zip(b["document_id"], b["page_number"], b["path_id"], b["points"]):
                if pts is None or len(pts) == 0:
                    continue
                a = np.array([np.asarray(x, dtype=float) for x in pts])
                if (v := bowtie(a)) is not None:
                    out.append((d, p, k, "valve", *v))
                elif (w := diamond(a)) is not None:
                    out.append((d, p, k, "weld", w[1], w[2]))
            yield pd.DataFrame(out, columns=["document_id", "page_number", "path_id", "kind", "x", "y"])

    return paths.select("document_id", "page_number", "path_id", "points").mapInPandas(run, "document_id string, page_number int, path_id bigint, kind string, x double, y double")


def tiles(pages: DataFrame, cols: int = 3, rows: int = 2, overlap: float = 0.08) -> DataFrame:
    """(page, row, col, x, y, w, h): a page's overlapping tiles, clipped at its edges; rows and columns count from 1."""
    grid = pages.select("page", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"))
    tw, th = F.col("width") / cols, F.col("height") / rows
    x, y = F.greatest(F.lit(0.0), F.col("c") * tw - tw * overlap), F.greatest(F.lit(0.0), F.col("r") * th - th * overlap)
    return grid.select("page", (F.col("r") + 1).alias("row"), (F.col("c") + 1).alias("col"), x.alias("x"), y.alias("y"), F.least(F.col("width") - x, tw * (1 + 2 * overlap)).alias("w"), F.least(F.col("height") - y, th * (1 + 2 * overlap)).alias("h"))


def multiplied(m: Column, ctm: Column) -> Column:
    """Product m × ctm of affine matrices given as [a, b, c, d, e, f]."""
    a, b, c, d, e, f = (m[i] for i in range(6))
    u, v, w, x, y, z = (ctm[i] for i in range(6))
    return F.array(a * u + b * w, a * v + b * x, c * u + d * w, c * v + d * x, e * u + f * w + y, e * v + f * x + z)


def moved(m: Column, x: Column, y: Column) -> Column:
    """struct<x, y>: a point under an affine matrix."""
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))
