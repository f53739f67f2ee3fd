"""Problems 8 to 10: brute force, invariants, held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoweave.llm import leakage, packing, reading

DOCS = "doc_id bigint, text string, lang string, tokens int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in rows], DOCS)


# --- 8 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_packing_in_memory(seed):
    rnd = np.random.default_rng(seed)
    cap = 1000
    sizes = rnd.integers(1, cap + 1, 400) if seed % 2 else rnd.choice([251, 252, 498, 499], 400)
    first = packing.fill(sizes, cap)
    bins = packing.improve(sizes, first, cap)
    load = np.bincount(bins, weights=sizes)
    assert load.max() <= cap and (load > 0).sum() <= first.max() + 1
    assert (load**2).sum() >= (np.bincount(first, weights=sizes) ** 2).sum()


def test_packing_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 60)
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0, 1, 40, 99, 100, 101, 250, 333])) for i in range(400)] + [(7, 50), (1000, 1000)]
    t = spark.createDataFrame(rows, "doc_id bigint, tokens int")
    out = packing.pack(t, [(3, 100), (4, 350)]).collect()
    for limit, cap in ((3, 100), (4, 350)):
        mine = [r for r in out if r.limit_id == limit]
        assert sum(r.tokens for r in mine) == sum(n for _, n in rows)
        load = {}
        for r in mine:
            load[r.container] = load.get(r.container, 0) + r.tokens
        assert max(load.values()) <= cap and len(load) <= 1.1 * sum(n for _, n in rows) / cap + 2
        assert {r.doc_id for r in mine if r.piece > 0} == {i for i, n in rows if n > cap}
    assert packing.pack(t.limit(0), [(3, 100)]).count() == 0


def test_token_counts(spark):
    got = {r.doc_id: r.tokens for r in packing.count_tokens(docs(spark, [(1, "hello world"), (2, ""), (3, None), (4, "x " * 20_000), (5, "<|endoftext|>")])).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 10_000 and got[5] > 1


# --- 9 -------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_DOCS", 7)
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([5, 12, 40])))) for i in range(20)] + [(3, "w1 " * 30), (50, None), (51, ""), (0, "other text of the same id " * 3)]
    rows = []
    for k in range(80):
        t = [rnd.choice(vocab + ["zz"] * 30) for _ in range(rnd.choice([0, 10, 60]))]
        if k % 3 == 0:
            w = rnd.choice([x for _, x in items if x]).split()
            a = rnd.randrange(max(1, len(w) - 5))
            t[5:5] = w[a : a + rnd.choice([8, 11, 12, 30])]
        rows.append((k, "  ".join(x.upper() if rnd.random() < 0.3 else x + rnd.choice(["", ",", ".\n"]) for x in t)))
    rows += [(500, None), (501, rows[0][1]), (501, rows[0][1]), (502, "é".join(items[1][1].split()))]
    grams = {}
    for i, t in items:
        w = leakage.words(t or "")
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t in rows:
        w = leakage.words(t or "")
        for k in range(len(w) - 11):
            want |= {(i, d) for i in grams.get(tuple(w[k : k + 12]), ())}
    it = spark.createDataFrame([(i, "x", t) for i, t in items], "item_id bigint, topic string, text string")
    got = [tuple(r) for r in leakage.leaks(docs(spark, rows), it).collect()]
    assert want and set(got) == want and len(got) == len(set(got))
    monkeypatch.setattr(leakage, "PASS_CHARS", 200)
    assert {tuple(r) for r in leakage.leaks(docs(spark, rows), it).collect()} == want
    assert leakage.leaks(docs(spark, []), it).count() == 0 and leakage.leaks(docs(spark, rows), it.limit(0)).count() == 0


def test_proximity_and_places(spark):
    w = [f"a{i}" for i in range(20)]
    near = w[:6] + ["xx"] + w[7:13] + ["yy"] + w[14:]
    it = spark.createDataFrame([(1, "t", " ".join(w))], "item_id bigint, topic string, text string")
    got = {r.doc_id: r for r in leakage.matches(docs(spark, [(1, "pre fix " + " ".join(w)), (2, " ".join(near)), (3, "a6 x a13 " * 5)]), it).collect()}
    assert (got[1].kind, got[1].words, got[1].doc_start) == ("phrase", 20, 2)
    assert (got[2].kind, got[2].words) == ("proximity", 11)


def nearest(item, text, n, slack):
    """Most words of a window of n of the item in order in the text, with one shift; all places and shifts are tried."""
    best = 0
    at = lambda p, w: 0 <= p < len(text) and text[p] == w
    for i in range(len(item) - n + 1):
        w = item[i : i + n]
        for p in range(-n, len(text)):
            on = [[at(p + d + k, w[k]) for k in range(n)] for d in range(-slack, slack + 1)]
            best = max(best, sum(on[slack]))
            for d in range(-slack, slack + 1):
                for k in range(1, n):
                    best = max(best, sum(on[slack][:k]) + sum(on[slack + d][k + max(0, -d) :]))
    return best


def test_proximity_against_brute_force(spark):
    rnd = random.Random(11)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, [rnd.choice(vocab) for _ in range(rnd.choice([12, 20]))]) for i in range(6)]
    rows = []
    for k in range(40):
        w = list(rnd.choice(items)[1])
        for _ in range(rnd.choice([0, 1, 2, 3, 4])):
            w[rnd.randrange(len(w))] = rnd.choice(["gone", rnd.choice(vocab)])
        if k % 3:
            at = rnd.randrange(1, len(w) - 1)
            w[at : at + (k % 2) * rnd.choice([1, 2])] = ["in"] * ((k + 1) % 2 * rnd.choice([1, 2, 3]))
        rows.append((k, [rnd.choice(vocab) for _ in range(k % 4)] + w + ["end"] * (k % 3)))
    it = spark.createDataFrame([(i, "t", " ".join(w)) for i, w in items], "item_id bigint, topic string, text string")
    want = {(i, d) for i, w in items for d, t in rows if nearest(w, t, 12, 2) >= 9}
    got = {(r.item_id, r.doc_id) for r in leakage.matches(docs(spark, [(d, " ".join(t)) for d, t in rows]), it).collect()}
    assert len(want) > 15 and got == want
    # Each text alone gets the same answer: words that only other texts hold decide nothing.
    for d, t in rows[:4]:
        assert {(r.item_id, r.doc_id) for r in leakage.matches(docs(spark, [(d, " ".join(t))]), it).collect()} == {x for x in want if x[1] == d}


def test_a_stored_index_serves_other_sets(spark):
    index = leakage.build_index(docs(spark, [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, None)]))
    for n, text in enumerate(["two three four", "nothing of it here", "TEN, eleven; twelve"]):
        it = spark.createDataFrame([(n, "t", text)], "item_id bigint, topic string, text string")
        assert [r.doc_id for r in leakage.search(index, it, n=3, near=None).collect()] == ([1] if n != 1 else [])


# --- 10 ------------------------------------------------------------------------------------------

PLAIN = ["Put the pump by the gate.", "The lid is hot.", "Do not run.", "Ask the boss first.", "Is the tank full?"]
HARD = [
    "Notwithstanding the hydrodynamic considerations that the practitioners of the discipline habitually associate with phenomenological irregularities, the determination remains provisional.",
    "Inasmuch as the interdependence of the probabilistic approximations is insufficiently constrained, the responsibility for their reconciliation devolves upon the nominated authority.",
]


def sample(seed, n=60):
    rnd = random.Random(seed)
    y = [rnd.choice([1, 4]) for _ in range(n)]
    return [" ".join(rnd.choice(PLAIN if k == 1 else HARD) for _ in range(6)) for k in y], np.array(y)


def test_levels_held_out_accuracy():
    m = reading.train(*sample(1))
    texts, y = sample(2)
    assert (reading.apply(m, texts)["level"].to_numpy() == y).mean() >= 0.95


def test_texts_without_level(spark):
    texts, y = sample(3)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "Nach dem Regen war die Armatur nass und wer prüft dann die Pumpe?" * 3), (903, "A1-22 B7 33 44-X 99 C3 12 7 8 9 10 11"), (904, " \n\t"), (905, HARD[0] * 3000), (0, texts[0])]
    ratings = spark.createDataFrame([(i, int(v), "r") for i, v in enumerate(y)] + [(0, int(y[0]), "s"), (77_777, 2, "r"), (5, None, "r")], "doc_id bigint, reading_level int, rater string")
    got = {r.doc_id: r.level for r in reading.levels(docs(spark, rows), ratings).collect()}
    assert [got[k] for k in (900, 901, 902, 903, 904)] == [None] * 5 and got[905] == 4
    assert np.mean([got[i] == v for i, v in enumerate(y)]) > 0.9
    assert reading.levels(docs(spark, rows), ratings).count() == len(rows)
    assert reading.levels(docs(spark, []), ratings.limit(0)).count() == 0
    assert reading.levels(docs(spark, rows[:3]), ratings.limit(0)).filter(F.col("level").isNotNull()).count() == 0
