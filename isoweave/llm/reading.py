"""Reading level of documents (problem 10).

Every sentence is classified by regularised linear models over character trigrams, words
and its shape; the word-weighted distribution of the sentences' levels is calibrated to a
level of the document. The models are trained on a bounded sample of the rated documents
and applied to all sentences of all documents. Features are computed for whole batches
with array operations: no loop over sentences or words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rated documents that the fit uses at most, and the share of them kept for calibration; a documented bound.
MAX_RATED, CALIBRATION = 1500, 0.3
#: Documents of one step; word buckets; steps, rate and penalty of the fit.
STEP, WORD_BITS, ROUNDS, RATE, PENALTY = 500, 18, 40, 0.12, 2e-4
#: English prose: least share of English function words, their lead over other languages, most tokens with digits.
ENGLISH, LEAD, CODES = 0.16, 1.5, 0.3
LEVELS = 4

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an of to in and or is are was were be been it its this that these those for from with by at on as not no if when while who what which there they we you he she his her our your their has have had do does did will would shall should may must can could one each every so but then than into out up down",
    "de": "der die das den dem des ein eine einer einem einen und oder ist sind war waren wird werden nicht kein keine auf mit von zu zum zur bei nach vor aus im am wenn dann noch schon wer was wie wir sie er es ich bitte für über durch sich auch als dass muss",
    "fr": "le la les un une des du de et ou est sont était ne pas que qui dans sur avec pour par au aux ce cette ces il elle nous vous ils se sa son ses mais plus avant après quand encore où à doit être",
    "es": "el la los las un una unos unas del de y o es son era no que en con por para al se su sus este esta estos lo le nos pero más antes después cuando ya quién dónde como debe hay fue está",
}
# End of fixed values.
SHORT, LONG = 3, 9

_CODE = np.zeros(256, dtype=np.uint8)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[ord("0") : ord("9") + 1] = 27
_CODE[128:] = 28
_POW = np.array([pow(1_000_003, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - WORD_BITS)).astype(np.int32)


@dataclass
class Sentences:
    """Features of a batch: sentences in order, with the document of each."""

    doc: np.ndarray
    grams: np.ndarray
    gram_start: np.ndarray
    n_grams: np.ndarray
    words: np.ndarray
    word_sent: np.ndarray
    n_words: np.ndarray
    shape: np.ndarray
    digits: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)


def featurise(texts: list[str | None]) -> Sentences:
    """Whole texts to sentences; null texts have none. A sentence ends at . ! ? before white space, at a paragraph or list item."""
    raw = [(t or "").lower().encode("utf-8", "replace") + b"\n" for t in texts]
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    doc_of = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    c = _CODE[buf]
    nl = (buf == 10) | (buf == 13)
    stop = (buf == 46) | (buf == 33) | (buf == 63)
    white = nl | (buf == 32) | (buf == 9)
    # A line's end closes a sentence after a stop, before an empty line, or before a list mark; else the line is wrapped.
    after = np.r_[nl[1:], True] | np.isin(np.r_[buf[1:], 10], np.frombuffer(b"-*0123456789", dtype=np.uint8))
    before = np.r_[True, stop[:-1] | nl[:-1] | (buf[:-1] == 58)]
    ends = nl & (after | before)
    ends[:-1] |= stop[:-1] & white[1:]
    ends[np.cumsum([len(r) for r in raw]) - 1] = True
    sent = np.cumsum(ends) - ends
    first = np.r_[0, np.flatnonzero(ends)[:-1] + 1]
    n = len(first)
    g = np.zeros(len(c), dtype=np.int32)
    g[1:-1] = (c[:-2].astype(np.int32) << 10) | (c[1:-1].astype(np.int32) << 5) | c[2:]
    isw = c > 0
    begin = isw.copy()
    begin[1:] &= ~isw[:-1]
    at = np.flatnonzero(begin)
    stop_at = isw.copy()
    stop_at[:-1] &= ~isw[1:]
    size = np.flatnonzero(stop_at) + 1 - at
    inside = np.flatnonzero(isw)
    offset = np.minimum(inside - np.repeat(at, size), 63)
    h = np.add.reduceat(c[inside].astype(np.uint64) * _POW[offset], np.r_[0, np.cumsum(size)[:-1]]) if len(at) else np.zeros(0, dtype=np.uint64)
    has_digit = np.add.reduceat((c[inside] == 27).astype(np.int32), np.r_[0, np.cumsum(size)[:-1]]) > 0 if len(at) else np.zeros(0, dtype=bool)
    ws = sent[at]
    nw = np.bincount(ws, minlength=n)
    some = np.maximum(nw, 1)
    per = lambda x: np.bincount(ws, weights=x, minlength=n) / some
    commas = np.bincount(sent[buf == 44], minlength=n) / some
    shape = np.stack([np.log1p(nw) - 2.5, per(size) / 5 - 1, per(size >= LONG) * 2, per(size <= SHORT) * 2 - 1, commas * 5], axis=1).astype(np.float32)
    digits = np.bincount(ws, weights=has_digit, minlength=n)
    return Sentences(doc_of[first], g, first, np.diff(np.r_[first, len(c)]), _bucket(h), ws, nw, shape, digits)


@dataclass
class Model:
    grams: np.ndarray
    words: np.ndarray
    shape: np.ndarray
    bias: np.ndarray
    doc: np.ndarray  # calibration: document features to levels

    def sentence_levels(self, s: Sentences) -> np.ndarray:
        return _softmax(_logits(s, self.grams, self.words, self.shape, self.bias))


def _logits(s: Sentences, wg: np.ndarray, ww: np.ndarray, wd: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.add.reduceat(wg[s.grams], s.gram_start, axis=0) * (8.0 / s.n_grams)[:, None]
    scale = 8.0 / np.maximum(s.n_words, 1)
    for k in range(LEVELS):
        out[:, k] += np.bincount(s.word_sent, weights=ww[s.words, k], minlength=len(s)) * scale
    return out + s.shape @ wd + b


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Adam:
    def __init__(self) -> None:
        self.m, self.v, self.t = None, None, 0

    def step(self, w: np.ndarray, g: np.ndarray) -> None:
        if self.m is None:
            self.m, self.v = np.zeros_like(w), np.zeros_like(w)
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        w -= (RATE * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)).astype(w.dtype)


def _fit_sentences(s: Sentences, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    wg, ww = np.zeros((1 << 15, LEVELS), np.float32), np.zeros((1 << WORD_BITS, LEVELS), np.float32)
    wd, b = np.zeros((s.shape.shape[1], LEVELS), np.float32), np.zeros(LEVELS, np.float32)
    used_g, gi = np.unique(s.grams, return_inverse=True)
    used_w, wi = np.unique(s.words, return_inverse=True)
    cg, cw = np.zeros((len(used_g), LEVELS), np.float32), np.zeros((len(used_w), LEVELS), np.float32)
    local = Sentences(s.doc, gi.astype(np.int32), s.gram_start, s.n_grams, wi.astype(np.int32), s.word_sent, s.n_words, s.shape, s.digits)
    target = np.eye(LEVELS)[y]
    ws_g = np.repeat(np.arange(len(s)), s.n_grams)
    opt = [_Adam() for _ in range(4)]
    total = weight.sum()
    for _ in range(ROUNDS):
        d = (_softmax(_logits(local, cg, cw, wd, b)) - target) * (weight / total)[:, None]
        dg, dw = d * (8.0 / s.n_grams)[:, None], d * (8.0 / np.maximum(s.n_words, 1))[:, None]
        gg = np.stack([np.bincount(gi, weights=dg[ws_g, k], minlength=len(used_g)) for k in range(LEVELS)], axis=1)
        gw = np.stack([np.bincount(wi, weights=dw[s.word_sent, k], minlength=len(used_w)) for k in range(LEVELS)], axis=1)
        opt[0].step(cg, gg + PENALTY * cg)
        opt[1].step(cw, gw + PENALTY * cw)
        opt[2].step(wd, s.shape.T @ d + PENALTY * wd)
        opt[3].step(b, d.sum(axis=0))
    wg[used_g], ww[used_w] = cg, cw
    return wg, ww, wd, b


def _doc_features(s: Sentences, p: np.ndarray, n: int) -> np.ndarray:
    """Word-weighted mean of the sentences' distributions, its logarithm, and the share of words by likeliest level."""
    w = s.n_words.astype(float)
    total = np.maximum(np.bincount(s.doc, weights=w, minlength=n), 1e-9)
    mean = np.stack([np.bincount(s.doc, weights=w * p[:, k], minlength=n) for k in range(LEVELS)], axis=1) / total[:, None]
    top = p.argmax(axis=1)
    share = np.stack([np.bincount(s.doc, weights=w * (top == k), minlength=n) for k in range(LEVELS)], axis=1) / total[:, None]
    return np.concatenate([mean * 4, np.log(mean + 0.02), share * 4, np.ones((n, 1))], axis=1)


def train(texts: list[str], levels: np.ndarray) -> Model:
    """Model from rated texts (levels 1 .. 4): sentences take their document's level, calibration uses other documents."""
    y = np.clip(np.asarray(levels, dtype=int) - 1, 0, LEVELS - 1)
    part = np.arange(len(texts)) % 100 < 100 * CALIBRATION if len(texts) >= 20 else np.zeros(len(texts), dtype=bool)
    a = np.flatnonzero(~part)
    s = featurise([texts[i] for i in a])
    weight = np.minimum(s.n_words, 40).astype(float)
    wg, ww, wd, b = _fit_sentences(s, y[a][s.doc], np.maximum(weight, 1e-6))
    model = Model(wg, ww, wd, b, np.zeros((3 * LEVELS + 1, LEVELS)))
    c = np.flatnonzero(part) if part.any() else a
    s = featurise([texts[i] for i in c])
    x, target = _doc_features(s, model.sentence_levels(s), len(c)), np.eye(LEVELS)[y[c]]
    opt, w = _Adam(), model.doc
    w[:LEVELS] = np.eye(LEVELS)
    for _ in range(300):
        opt.step(w, x.T @ (_softmax(x @ w) - target) / len(c) + 1e-3 * w)
    return model


def _language_table() -> np.ndarray:
    out = np.zeros(1 << WORD_BITS, dtype=np.uint8)
    for k, ws in enumerate(FUNCTION_WORDS.values()):
        s = featurise([" ".join(ws.split())])
        out[np.unique(s.words)] |= 1 << k
    return out


def apply(model: Model, texts: list[str | None]) -> pd.DataFrame:
    """level (null where the text is no English prose), p1 .. p4, english, codes, words by document."""
    n = len(texts)
    s = featurise(texts)
    lang = _language_table()[s.words]
    doc_w = s.doc[s.word_sent]
    total = np.maximum(np.bincount(doc_w, minlength=n), 1)
    shares = [np.bincount(doc_w, weights=(lang & (1 << k)) > 0, minlength=n) / total for k in range(len(FUNCTION_WORDS))]
    codes = np.bincount(s.doc, weights=s.digits, minlength=n) / total
    x = _doc_features(s, model.sentence_levels(s), n)
    # The calibrated distribution, and for texts of mixed levels the share of words at each level, count alike.
    p = (_softmax(x @ model.doc) + x[:, 2 * LEVELS : 3 * LEVELS] / 4) / 2
    words = np.bincount(doc_w, minlength=n)
    prose = (shares[0] >= ENGLISH) & (shares[0] >= LEAD * np.max(shares[1:], axis=0)) & (codes <= CODES) & (words >= 5)
    out = pd.DataFrame({f"p{k + 1}": p[:, k] for k in range(LEVELS)})
    out["english"], out["codes"], out["words"] = shares[0], codes, words.astype(np.int64)
    out.insert(0, "level", pd.array(np.where(prose, p.argmax(axis=1) + 1, 0), dtype="Int64"))
    out.loc[~prose, "level"] = pd.NA
    return out


def rated_sample(docs: DataFrame, ratings: DataFrame, bound: int = MAX_RATED) -> pd.DataFrame:
    """At most ``bound`` rated documents (median of their ratings), in an order that hangs on doc_id alone."""
    once = ratings.filter("reading_level between 1 and 4").groupBy("doc_id").agg(F.percentile_approx("reading_level", 0.5).alias("level"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()


COLUMNS = "doc_id bigint, level int, p1 double, p2 double, p3 double, p4 double, english double, codes double, words bigint"


def levels(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Level and its distribution for every document.

    level is null for other languages, registers of codes, and empty or null texts; such rows keep their other
    columns. Repeated documents are rated alike. Without ratings every level is null.
    """
    sample = rated_sample(docs, ratings)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(list(sample["text"]), sample["level"].to_numpy()) if len(sample) else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            for lo in range(0, len(b), STEP):
                part = b.iloc[lo : lo + STEP]
                if m is None:
                    out = pd.DataFrame({"level": pd.array([None] * len(part), dtype="Int64"), **{f"p{k}": 0.0 for k in (1, 2, 3, 4)}, "english": 0.0, "codes": 0.0, "words": 0})
                else:
                    out = apply(m, [t if isinstance(t, str) else None for t in part["text"]])
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield out

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, COLUMNS)
