"""Oversized items cut at natural boundaries (problem 5).

Method: balanced targets. The least number of pieces gives equal-length targets; each
target moves to the strongest boundary near it; if a piece then breaks the limit, a piece
is added. Lengths are summed first, so texts of items within the limit never move. Items
larger than a segment are cut in bounded segments of whole parts, each with the tail of
the segment before it as context, so no task holds more than a segment.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import materialise
from ..sources.pages import located_sheets

#: Characters of a segment, parts of a bucket in the running sums, share of a piece within which a target may move.
SEGMENT_CHARS, BUCKET_PARTS, REACH = 2_000_000, 4096, 0.2

#: Boundaries from the strongest: between parts, paragraphs, lines, sentences, clauses or cells, words.
_BOUNDARIES = [
    (5, re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)+")),
    (4, re.compile(r"\r\n|\r|\n")),
    (3, re.compile(r"[.!?:]['\")\]]*\s+")),
    (2, re.compile(r"[,;]\s+|\t|\|")),
    (1, re.compile(r"\s+")),
]


@dataclass(frozen=True)
class Limit:
    capacity: int
    overlap: int

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.capacity:
            raise ValueError(f"an overlap of {self.overlap} leaves no room in {self.capacity}")


def _snap(text: str, target: int, low: int, high: int, joints: list[int]) -> int:
    """Strongest boundary in [low, high], the nearest of equal ones; the target itself where there is none."""
    inside = [j for j in joints if low <= j <= high]
    if inside:
        return min(inside, key=lambda j: abs(j - target))
    window = text[max(0, low - 4) : high + 4]
    base = max(0, low - 4)
    for _, pattern in _BOUNDARIES:
        at = [m.end() + base for m in pattern.finditer(window)]
        at = [a for a in at if low <= a <= high]
        if at:
            return min(at, key=lambda a: abs(a - target))
    if 0 < target < len(text) and text[target - 1 : target + 1] == "\r\n":
        target -= 1
    return target


def cuts(text: str, limit: Limit, joints: list[int] | None = None, context: int = 0) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text`` without their overlaps; one piece if the text is within the limit.

    A piece is text[max(0, start - overlap) : end]. context: characters before the text that the first piece repeats.
    """
    n_chars, ov = len(text), limit.overlap
    lead = min(context, ov)
    if n_chars + lead <= limit.capacity:
        return [(0, n_chars)]
    n = -(-(n_chars + lead - ov) // (limit.capacity - ov))
    joints = joints or []
    while True:
        size = (n_chars + lead + (n - 1) * ov) / n
        reach = int(min(REACH * (size - ov), (size - ov - 1) / 2)) if size - ov > 1 else 0
        at, fits = [0], True
        for k in range(1, n):
            target = round(size - lead + (k - 1) * (size - ov))
            low, high = max(at[-1] + 1, target - reach), min(n_chars - 1, target + reach)
            room = at[-1] + limit.capacity - (ov if k > 1 else lead)
            high = min(high, room)
            if low > high:
                fits = False
                break
            at.append(_snap(text, min(max(target, low), high), low, high, joints))
        at.append(n_chars)
        fits = fits and all(b - max(0, a - ov) <= limit.capacity for a, b in zip(at[1:], at[2:])) and at[1] + lead <= limit.capacity
        if fits:
            return list(zip(at, at[1:]))
        n += 1


def _splitter(limit: Limit) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    cols = ["item_kind", "owner_id", "sheet_pos"]

    def split(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset", kind="stable")
        before = "".join(rows.loc[rows["context"], "text"])
        own = rows[~rows["context"]]
        if own.empty:
            return pd.DataFrame(columns=[*cols, "piece_start", "piece_end", "piece_text"])
        text = "".join(own["text"])
        base = int(own["offset"].iloc[0])
        joints = [int(o) - base for o in own["offset"].iloc[1:]]
        tail = before[len(before) - min(len(before), limit.overlap) :]
        out = []
        for a, b in cuts(text, limit, joints, len(tail)):
            body = tail + text[a:b] if a == 0 else text[max(0, a - limit.overlap) : b]
            out.append((base + b - len(body), base + b, body))
        first = own.iloc[0]
        return pd.DataFrame([(first["item_kind"], first["owner_id"], first["sheet_pos"], *p) for p in out], columns=[*cols, "piece_start", "piece_end", "piece_text"])

    return split


def offsets(lengths: DataFrame, item: list[str], order: str) -> DataFrame:
    """Adds ``offset``, the running sum of ``len`` before each part, in two levels so that no window holds a whole item."""
    b = lengths.withColumn("_b", F.floor(F.col(order) / BUCKET_PARTS))
    sums = b.groupBy(*item, "_b").agg(F.sum("len").alias("_s"))
    before = Window.partitionBy(*item).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*item, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return b.join(base, [*item, "_b"]).withColumn("offset", F.col("_base") + F.coalesce(F.sum("len").over(inside), F.lit(0))).drop("_b", "_base")


PIECES = "item_kind string, owner_id string, sheet_pos int, piece_start bigint, piece_end bigint, piece_text string"


def split_parts(parts: DataFrame, limit: Limit) -> DataFrame:
    """Pieces of items given as parts (item_kind, owner_id, sheet_pos, offset, text), parts of an item without gaps.

    A part longer than a segment stays whole in its segment, as it is one value already.
    """
    end = F.col("offset") + F.length("text")
    seg = F.floor(F.col("offset") / SEGMENT_CHARS)
    own = parts.withColumn("segment", seg).withColumn("context", F.lit(False))
    tails = parts.withColumn("segment", seg + 1).filter(end > F.col("segment") * SEGMENT_CHARS - limit.overlap).withColumn("context", F.lit(True))
    return own.unionByName(tails).groupBy("item_kind", "owner_id", "sheet_pos", "segment").applyInPandas(_splitter(limit), PIECES)


def _page_pieces(limit: Limit) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for owner, text in zip(b["owner_id"], b["text"]):
                for s, e in cuts(text, limit):
                    s = max(0, s - limit.overlap)
                    rows.append(("page", owner, 0, s, e, text[s:e]))
            yield pd.DataFrame(rows, columns=["item_kind", "owner_id", "sheet_pos", "piece_start", "piece_end", "piece_text"])

    return run


def page_pieces(pages: DataFrame, limit: Limit) -> DataFrame:
    """Pieces of every page text above the limit; null and short texts have none, repeated rows one set each."""
    big = pages.filter(F.length("page_text") > limit.capacity).select(F.col("id").cast("string").alias("owner_id"), F.col("page_text").alias("text"))
    return big.mapInPandas(_page_pieces(limit), PIECES)


def sheet_pieces(results: DataFrame, pages: DataFrame, limit: Limit) -> DataFrame:
    """Pieces of the joined page texts of every located sheet above the limit.

    Of two rows for one page number the one with the highest id holds; a null text counts as empty; nothing is added
    between pages; a sheet without pages has no pieces.
    """
    item = ["item_kind", "owner_id", "sheet_pos"]
    valid = pages.filter("document_id is not null and page_number is not null").groupBy("document_id", "page_number").agg(F.max(F.struct("id", F.coalesce(F.length("page_text"), F.lit(0)).alias("len"))).alias("p"))
    sheets = located_sheets(results)
    on: Column = (sheets["document_id"] == valid["document_id"]) & F.col("page_number").between(F.col("first"), F.col("last"))
    # Ids and lengths only; stored, as the totals, the running sums and the places all read them.
    lens = materialise(sheets.join(valid, on).select(F.lit("sheet").alias("item_kind"), "owner_id", "sheet_pos", "page_number", F.col("p.id").alias("page_id"), F.col("p.len").alias("len")), "page-lengths")
    over = lens.groupBy(*item).agg(F.sum("len").alias("total")).filter(F.col("total") > limit.capacity).select(*item)
    placed = offsets(lens.join(over, item), item, "page_number")
    parts = placed.join(pages.select(F.col("id").alias("page_id"), F.coalesce("page_text", F.lit("")).alias("text")), "page_id").select(*item, "offset", "text")
    return split_parts(parts, limit)


def limits(size_limits: DataFrame) -> dict[str, Limit]:
    """Character limits by what they apply to. The table holds one row per kind of item."""
    rows = size_limits.filter("unit = 'characters'").orderBy("limit_id").select("applies_to", "capacity", "overlap").toLocalIterator()
    return {r["applies_to"]: Limit(r["capacity"], r["overlap"] or 0) for r in rows}


def pieces(results: DataFrame, pages: DataFrame, size_limits: DataFrame) -> DataFrame:
    lim = limits(size_limits)
    return page_pieces(pages, lim["document_pages.page_text"]).unionByName(sheet_pieces(results, pages, lim["sheet text"]))
