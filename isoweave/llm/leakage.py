"""Evaluation texts inside training texts (problem 9).

A positional inverted index of all words of the corpus is stored as a table that serves any
later evaluation set. It is partitioned by document: a row holds the posting lists (word to
documents and positions) of a block of documents, so lists of one document always meet in one
row and no intersection needs a shuffle. Document frequencies come from the index. In every
window of MIN_WORDS words of an evaluation text the rarest words are looked up and their
position lists intersected after adjusting for their offsets; what is left is checked word by
word against the index, which gives exact phrases (consecutive words in place) and proximity
matches (most words of a window in order, a few words put in or left out at one place).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise

#: Consecutive words that make a leak; words of such a window in order that make a proximity match; words that may be
#: put in or left out at one place of it; documents and characters from which a block is full (a document is never cut).
MIN_WORDS, NEAR_WORDS, SLACK, BLOCK_DOCS, BLOCK_CHARS = 12, 9, 2, 2_000, 4_000_000
_WORD = re.compile(rb"[a-z0-9]+")


def words(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits in lower case."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


INDEX = "docs array<bigint>, terms array<binary>, starts array<int>, doc array<int>, pos array<int>"


def _block(ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """Posting lists of one block: the postings of terms[i] are doc/pos[starts[i] : starts[i + 1]], sorted."""
    known: dict[bytes, int] = {}
    term, doc, pos = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for k, text in enumerate(texts):
        t = np.array([known.setdefault(w, len(known)) for w in words(text)], dtype=np.int32)
        term.append(t)
        doc.append(np.full(len(t), k, dtype=np.int32))
        pos.append(np.arange(len(t), dtype=np.int32))
    t, d, p = np.concatenate(term), np.concatenate(doc), np.concatenate(pos)
    order = np.argsort(t, kind="stable")  # document and position are in order already
    starts = np.r_[0, np.cumsum(np.bincount(t, minlength=len(known)))].astype(np.int32)
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    cols = [one(pa.array(ids, pa.int64())), one(pa.array(list(known), pa.binary())), one(pa.array(starts)), one(pa.array(d[order])), one(pa.array(p[order]))]
    return pa.RecordBatch.from_arrays(cols, names=["docs", "terms", "starts", "doc", "pos"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, chars = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text or i is None:
                continue
            ids.append(i)
            texts.append(text)
            chars += len(text)
            if len(ids) >= BLOCK_DOCS or chars >= BLOCK_CHARS:
                yield _block(ids, texts)
                ids, texts, chars = [], [], 0
    if ids:
        yield _block(ids, texts)


def build_index(docs: DataFrame) -> DataFrame:
    """The index over whole texts, stored, one row per block of documents; null and empty texts have no postings.

    A block is a row group of its own, so that a task reads one block at a time however many a file has.
    """
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return materialise(src.mapInArrow(_index, INDEX), "postings", group_rows=1)


def eval_words(items: DataFrame) -> tuple[list[tuple[int, list[bytes]]], dict[bytes, int]]:
    """Words of every evaluation text and the vocabulary. The driver reads one pass of them, at most PASS_CHARS on average."""
    rows = [(int(r[0]), words(r[1] or "")) for r in items.filter("item_id is not null").select("item_id", "text").toLocalIterator()]
    vocabulary: dict[bytes, int] = {}
    for _, ws in rows:
        for w in ws:
            vocabulary.setdefault(w, len(vocabulary))
    return rows, vocabulary


def frequencies(index: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Occurrences of every word of the vocabulary in the corpus: one row per word reaches the driver."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1)):
                here = [shared.value.get(t, -1) for t in terms.as_py()]
                t = np.array(here, dtype=np.int64)
                n = np.diff(np.asarray(starts.values))
                total[t[t >= 0]] += n[t >= 0]  # a block holds a word once
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in index.select("terms", "starts").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r[0]] = r[1]
    return out


def seeds(rows: list[tuple[int, list[bytes]]], vocabulary: dict[bytes, int], df: np.ndarray, n: int, near: int | None) -> np.ndarray:
    """Rows (item, term, place), each once, in order of items: the rarest words of every window of n words.

    A phrase has the two rarest words of its window in place. A window of which n - near words are missing in a text
    still has two of its 2 + n - near rarest words there, so for proximity that many are taken. A word that the corpus
    does not hold counts as missing beforehand, so the answer for a text depends on no other text.
    """
    out: set[tuple[int, int, int]] = set()
    for item, ws in rows:
        rank = [(int(df[vocabulary[w]]), vocabulary[w], i) for i, w in enumerate(ws)]
        for s in range(len(rank) - n + 1):
            held = [r for r in rank[s : s + n] if r[0]]
            missing = (0 if near is None else n - near) - (n - len(held))
            if missing >= 0:
                out.update((item, t, i) for _, t, i in heapq.nsmallest(2 + missing, held))
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 3)


#: Characters of evaluation texts of one pass; larger sets search the stored index in several passes. Postings merged at a time.
PASS_CHARS, MERGED = 20_000_000, 4_000_000
RESULT = "item_id bigint, doc_id bigint, kind string, words int, doc_start int"


def _longest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and end of the longest run of True in each row."""
    run, best, end = np.zeros(len(hit), np.int64), np.zeros(len(hit), np.int64), np.zeros(len(hit), np.int64)
    for p in range(hit.shape[1]):
        run = (run + 1) * hit[:, p]
        up = run > best
        best[up], end[up] = run[up], p + 1
    return best, end


def _in_order(hit: np.ndarray, n: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Most words of a window of n in order and that window's place, with one shift of up to ``slack`` words.

    hit: row, shift (-slack .. slack), place: whether the text has the item's word there. A window is read on one shift
    up to some place and on another after it; words that a smaller shift would read twice are passed over.
    """
    rows, shifts, width = hit.shape
    n = min(n, width)
    c = np.zeros((rows, shifts, width + 1), np.int16)
    np.cumsum(hit, axis=2, out=c[:, :, 1:])
    places = width - n + 1
    mid = c[:, slack]
    best = (mid[:, n:] - mid[:, :places]).copy()
    for other in range(shifts):
        d = other - slack
        if not d:
            continue
        for k in range(1, n):
            for first, second, skip in ((mid, c[:, other], max(0, -d)), (c[:, other], mid, max(0, d))):
                if k + skip < n:
                    np.maximum(best, first[:, k : k + places] - first[:, :places] + second[:, n : n + places] - second[:, k + skip : k + skip + places], out=best)
    return best.max(axis=1), best.argmax(axis=1)


def _lines(seed: np.ndarray, row_of: np.ndarray, starts: np.ndarray, key: np.ndarray, slack: int) -> list[tuple[int, np.ndarray]]:
    """(item, places where its first word would be) on which two of its seeds meet, up to ``slack`` words apart.

    The posting lists of an item's seeds are shifted by their places and merged; neighbours in the merged list meet.
    """
    row = row_of[seed[:, 1]]
    n = starts[row + 1] - starts[row]
    first = np.flatnonzero(np.r_[True, seed[1:, 0] != seed[:-1, 0]]) if len(seed) else np.zeros(0, np.int64)
    out, lo = [], 0
    size = np.add.reduceat(n, first) if len(seed) else n
    while lo < len(first):  # whole items, MERGED postings or one item at a time
        hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), MERGED, side="right")))
        part = slice(first[lo], first[hi] if hi < len(first) else len(seed))
        m = n[part]
        at = np.repeat(starts[row[part]] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
        line, item = key[at] - np.repeat(seed[part, 2], m), np.repeat(seed[part, 0], m)
        order = np.lexsort((line, item))
        line, item = line[order], item[order]
        meet = (item[1:] == item[:-1]) & (line[1:] - line[:-1] <= slack)
        both = np.r_[meet, False] | np.r_[False, meet]
        line, item = line[both], item[both]
        fresh = np.r_[True, (line[1:] != line[:-1]) | (item[1:] != item[:-1])] if len(line) else both[:0]
        line, item = line[fresh], item[fresh]
        cut = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else []
        out += [(int(item[i]), line[i:j]) for i, j in zip(cut, [*cut[1:], len(item)])]
        lo = hi
    return out


def _search(block: dict, seed: np.ndarray, places: dict[int, np.ndarray], vocabulary: dict[bytes, int], n: int, near: int | None, slack: int) -> list[tuple]:
    known = np.array([vocabulary.get(t, -1) for t in block["terms"]], dtype=np.int32)
    if not (known >= 0).any():
        return []
    starts = block["starts"].astype(np.int64)
    # All texts of the block in a row, with so much room between them that no window reaches from one to the next.
    room = n + slack
    length = np.bincount(block["doc"], minlength=len(block["docs"]))
    base = np.cumsum(length + room) - length
    key = base[block["doc"]] + block["pos"]
    wide = max((len(x) for x in places.values()), default=0) + room
    row = np.full(int(base[-1] + length[-1]) + 2 * wide, -1, np.int32)
    row[key + wide] = np.repeat(known, np.diff(starts))
    row_of = np.full(len(vocabulary), -1, np.int64)  # where a word's postings are in this block
    row_of[known[known >= 0]] = np.flatnonzero(known >= 0)
    docs, out = block["docs"], []
    for item, start in _lines(seed[row_of[seed[:, 1]] >= 0], row_of, starts, key, slack if near else 0):
        want = places[item]
        step = max(1, 100_000 // len(want))
        along = np.arange(len(want)) + wide
        for lo in range(0, len(start), step):
            s = start[lo : lo + step]
            look = s[:, None] + along
            hit = row[look] == want
            shifts = [hit if not d else row[look + d] == want for d in (range(-slack, slack + 1) if near else (0,))]
            # Words in place on any shift bound the words in order from above.
            some = np.zeros((len(s), len(want) + 1), np.int32)
            np.cumsum(np.logical_or.reduce(shifts) if near else hit, axis=1, out=some[:, 1:])
            good = np.flatnonzero((some[:, n:] - some[:, :-n]).max(axis=1) >= (near or n))
            if not len(good):
                continue
            best, end = _longest(hit[good])
            exact = best >= n
            most, where = best.copy(), end - best
            if near and not exact.all():
                rest = ~exact
                most[rest], where[rest] = _in_order(np.stack([x[good[rest]] for x in shifts], axis=1), n, slack)
            for r in np.flatnonzero(exact | (most >= (near or n))):
                first = int(s[good[r]]) + int(where[r])
                doc = int(np.searchsorted(base - room, first, side="right")) - 1  # a window may begin in the room before its text
                out.append((item, int(docs[doc]), "phrase" if exact[r] else "proximity", int(most[r]), max(0, first - int(base[doc]))))
    return out


def search(index: DataFrame, items: DataFrame, n: int = MIN_WORDS, near: int | None = NEAR_WORDS, slack: int = SLACK) -> DataFrame:
    """Matches of evaluation texts in a stored index, as `matches` gives them; near None looks for phrases only."""
    spark: SparkSession = index.sparkSession
    passes = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // PASS_CHARS))
    if passes > 1:
        part = F.pmod(F.xxhash64("item_id"), F.lit(passes))
        return reduce(DataFrame.unionByName, [_pass(index, items.filter(part == k), n, near, slack) for k in range(passes)])
    return _pass(index, items, n, near, slack)


def _pass(index: DataFrame, items: DataFrame, n: int, near: int | None, slack: int) -> DataFrame:
    spark = index.sparkSession
    rows, vocabulary = eval_words(items)
    if not vocabulary:
        return spark.createDataFrame([], RESULT)
    names = [i for i, _ in rows]  # a repeated item_id may stand for several texts
    seed = seeds([(k, ws) for k, (_, ws) in enumerate(rows)], vocabulary, frequencies(index, vocabulary), n, near)
    places = {k: np.array([vocabulary[w] for w in ws], dtype=np.int64) for k, (_, ws) in enumerate(rows) if len(ws) >= n}
    shared = spark.sparkContext.broadcast((seed, places, vocabulary))  # of the size of the pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = {c: batch.column(i)[r].values for i, c in enumerate(batch.schema.names)}
                block = {c: v.to_pylist() if c == "terms" else v.to_numpy(zero_copy_only=False) for c, v in block.items()}
                found = [(names[k], *rest) for k, *rest in _search(block, *shared.value, n, near, slack)]
                if found:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=["item_id", "doc_id", "kind", "words", "doc_start"]).astype({"words": "int32", "doc_start": "int32"}), preserve_index=False)

    found = index.mapInArrow(run, RESULT)
    best = found.groupBy("item_id", "doc_id").agg(F.max(F.struct((F.col("kind") == "phrase").alias("exact"), "words", (-F.col("doc_start")).alias("s"))).alias("b"))
    return best.select("item_id", "doc_id", F.when(F.col("b.exact"), "phrase").otherwise("proximity").alias("kind"), "b.words", (-F.col("b.s")).alias("doc_start"))


def matches(docs: DataFrame, items: DataFrame, n: int = MIN_WORDS, near: int | None = NEAR_WORDS, slack: int = SLACK) -> DataFrame:
    """(item_id, doc_id, kind, words, doc_start): the best match per item and document.

    kind 'phrase': at least n consecutive words; words is the length of the run. kind 'proximity': no such run, but
    at least ``near`` words of a window of n in order, with at most one place where up to ``slack`` words are put in or
    left out; words is their number. An item or text of fewer than n words matches nothing; a repeated doc_id gives one
    row per item; null texts and ids match nothing. Extra columns are ignored.
    """
    return search(build_index(docs), items, n, near, slack)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    return matches(docs, items, near=None).select("item_id", "doc_id")
