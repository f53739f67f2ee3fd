"""Problems 1, 2 and 7: forms, edge cases, brute force."""

import json
import random

from pyspark.sql import functions as F

from isoweave.operators import references, shred, units
from isoweave.runtime import materialise

SHEETS = [
    {"a": 1, "result": {"welds": [{"t": "x"}, None, "continued", {"t": "y", "n": {"deep": 2}}]}},
    {"a": "text", "result": {"welds": {"t": "lone"}}},
    {"result": {"welds": json.dumps([{"t": "in text"}])}},
    {"result": json.dumps({"welds": [{"t": "object as text"}]})},
    {"result": None},
    {"result": {"welds": None}},
    None,
    "see sheet 2",
]


def rows(spark, texts):
    return spark.createDataFrame([(f"r{i}", t, "v") for i, t in enumerate(texts)], "id string, raw string, level string")


def test_shred_forms(spark):
    df = rows(spark, [json.dumps({"sheets": SHEETS}), '{"sheets": [{"result": {"welds": [{"t"', None, "", "{} x {", "[]", json.dumps({"sheets": SHEETS[1]})])
    s = shred.shred(df, "raw", ["id"], root="sheets", only={"welds"})
    got = sorted((r.id, tuple(r.ords)) for r in s.rows.filter(shred.is_object(F.col("v"))).collect() if len(r.ords) == 2)
    assert got == [("r0", (0, 0)), ("r0", (0, 3)), ("r0", (1, 0)), ("r0", (2, 0)), ("r0", (3, 0)), ("r6", (0, 0))]


def test_shred_finds_fields_that_are_never_arrays(spark):
    for form in ({"t": 1}, json.dumps([{"t": 1}])):
        s = shred.shred(rows(spark, [json.dumps({"welds": form})]), "raw", ["id"], only={"welds"})
        assert [tuple(r.ords) for r in s.rows.filter(shred.is_object(F.col("v")) & (F.size("ords") == 1)).collect()] == [(0,)]


def test_shred_flat_tables_and_schema(spark):
    df = rows(spark, [json.dumps({"sheets": SHEETS[:3]}), json.dumps({"sheets": SHEETS[:3]})])
    s = shred.shred(df, "raw", ["id"], root="sheets")
    assert "result.welds" in s.schema["sheets"].repeated
    flat = s.flat("sheets/result.welds")
    assert set(flat.columns) >= {"id", "parent_ords", "pos", "t", "n__deep", "scalar_text"}
    assert flat.filter("t is not null").count() == 8 and flat.filter("scalar_text = 'continued'").count() == 2


def test_shred_empty_clash_and_wide(spark):
    empty = shred.shred(rows(spark, []), "raw", ["id"])
    assert empty.rows.count() == 0
    clash = shred.shred(rows(spark, [json.dumps({"items": [{"id": 1, "pos": 2, "v": "w"}]})]), "raw", ["id"], root="items")
    assert {"id", "id_2", "pos_2", "v"} <= set(clash.flat("items").columns)
    wide = shred.shred(rows(spark, [json.dumps({f"k{i}": [1] for i in range(30)})]), "raw", ["id"], max_fields=20)
    assert wide.schema["$"].wide == ["$"] and wide.rows.filter("level = '$/{}'").count() == 30
    assert wide.flat("$/{}").filter("key = 'k7'").count() == 1 and wide.rows.filter("level = '$/{}/value'").count() == 30
    asked = shred.shred(rows(spark, [json.dumps({f"k{i}": 1 for i in range(30)} | {"welds": [{"t": 1}]})]), "raw", ["id"], only={"welds"}, max_fields=20)
    assert asked.rows.filter("level = '$/welds'").count() == 1


def test_shred_goes_to_the_last_level_whatever_the_names(spark):
    deep = {"f": [1]}
    for name in "edcba":
        deep = {name: [deep]}
    s = shred.shred(rows(spark, [json.dumps(deep)]), "raw", ["id"])
    assert {r.level for r in s.rows.select("level").collect()} == {"$", *("$/" + "/".join("abcdef"[:n]) for n in range(1, 7))}
    named = {"bom-items": [{"x y": 1}], "a b": [2], "d.t": [3], "q'u\"o.t": [4], "": [5], " lead": [6], "b`t": [7], "h?": [{"z/y": [1]}]}
    n = shred.shred(rows(spark, [json.dumps(named)]), "raw", ["id"])
    assert n.rows.filter(F.size("ords") == 1).count() == 8 and n.rows.filter(F.size("ords") == 2).count() == 1
    assert n.flat("$/bom-items").select("x y").first()[0] == 1 and shred.steps(shred.joined(list(named))) == [k or "" for k in named]


def test_shred_explodes_arrays_of_arrays(spark):
    s = shred.shred(rows(spark, [json.dumps({"m": [[1, {"k": 2}], [[{"z": 9}]], {"k": 3}]})]), "raw", ["id"])
    got = sorted((r.level, tuple(r.ords)) for r in s.rows.collect() if r.level != "$")
    assert got == [("$/m", (0,)), ("$/m", (1,)), ("$/m", (2,)), ("$/m/[]", (0, 0)), ("$/m/[]", (0, 1)), ("$/m/[]", (1, 0)), ("$/m/[]/[]", (1, 0, 0))]


def test_shred_reads_valid_text_with_blanks_after_it(spark):
    texts = ['{"a": [1]}' + " " * 70 + "\n", '{"a": [1]} x {', '{"a": [1]}}', '{"a": [1]}, 2', '{"a": [1]}] x']
    s = shred.shred(rows(spark, texts), "raw", ["id"])
    assert {r.id for r in s.rows.collect()} == {"r0"}


def test_shred_keys_tell_repeated_records_apart(spark):
    df = rows(spark, [json.dumps({"items": [{"sub": [1, 2]}]})] * 3).withColumn("id", F.lit(None).cast("string"))
    s = shred.shred(df, "raw", ["id"])
    top, low = s.flat("$/items").collect(), s.flat("$/items/sub").collect()
    assert len({r.element_key for r in top}) == 3 and len({r.element_key for r in low}) == 6
    assert {r.parent_key for r in low} == {r.element_key for r in top}


def test_shred_long_text_and_null_key(spark):
    big = json.dumps({"items": [{"t": "x" * 50_000}] * 20})
    df = spark.createDataFrame([(None, big)], "id string, raw string")
    assert shred.shred(df, "raw", ["id"], root="items").rows.filter(shred.is_object(F.col("v"))).count() == 20


def basis(spark, rows_):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows_)], "id bigint, field string, iso_value string, pll_value string, remarks string")


def test_units_edges(spark):
    df = basis(spark, [
        ("Design pressure", "10 barg", "1000 kPag", None),
        ("DESIGN TEMPERATURE", "100 °C", "212 °F", ""),
        ("Insulation thickness", "10", "10 cm", "ISO thicknesses in cm"),
        ("Corrosion allowance", "3,0 mm", "0.118 in", None),
        ("Test pressure", "1,134 mbarg", "1.134", None),
        ("Design pressure", "XX barg", "3", None),
        ("Design pressure", None, "", None),
        ("Heat trace", "ET", "ET", None),
        ("Design pressure", "10 furlong", "10", None),
        (None, "1", "2", None),
        ("Design pressure", "20 barg", "25", "unit on PLL: bar; checked"),
    ])
    h = units.harmonise(df)
    got = {r.id: (r.iso_common, r.pll_common, r.d) for r in h.rows.select("*", units.differ(F.col("quantity"), F.col("iso_common"), F.col("pll_common")).alias("d")).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 6, 8, 10}
    assert [got[k][2] for k in (0, 1, 2, 3, 4, 10)] == [False, False, False, False, False, True]
    assert got[5][0] is None and got[6][:2] == (None, None) and got[8][0] is None
    assert units.harmonise(basis(spark, [])).rows.count() == 0


def test_units_are_learnt_from_the_data(spark):
    rnd = random.Random(1)
    rows_ = []
    for _ in range(300):
        v = rnd.uniform(5, 100)
        wrong = rnd.random() < 0.1
        rows_.append(("Design pressure", f"{v:.3f}", f"{v * 14.5038 * (2 if wrong else 1):.2f} zorks", None))
        t = rnd.uniform(20, 400)
        rows_.append(("Design temperature", f"{t:.1f}", f"{t * 1.8 + 32:.1f} zeds", None))
    u = {(r.quantity, r.unit): r for r in units.harmonise(basis(spark, rows_)).units.collect()}
    assert abs(u["pressure", "zorks"].scale - 0.0689476) < 1e-6 and u["pressure", "zorks"].basis == "estimated"
    assert abs(u["temperature", "zeds"].scale - 5 / 9) < 1e-9 and abs(u["temperature", "zeds"].offset + 160 / 9) < 1e-6


def test_orphans_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(references, "GROUP_ROWS", 50)
    monkeypatch.setattr(references, "RANGE_PARENTS", 40)
    rnd = random.Random(2)
    parents = [f"p{rnd.randrange(300)}" for _ in range(400)]
    refs = [(f"p{rnd.randrange(400)}" if rnd.random() < 0.6 else "hot-missing", i) for i in range(2000)] + [(None, 9999)]
    p = spark.createDataFrame([(x,) for x in [*parents, None]], "key string")
    r = spark.createDataFrame(refs, "key string, n int")
    got = sorted(x[0] for x in references.orphans(r, p).collect())
    assert got == sorted(n for k, n in refs if k is not None and k not in set(parents))
    assert references.orphans(r, p.limit(0)).count() == 2000 and references.orphans(r.limit(0), p).count() == 0


def test_last_number_and_given(spark):
    texts = ["ISO-25-A-S02", "SP.007 -", "none", None, "000", " NA\u00a0", "xx", "NA,", "N/A -", "- -", "-.", "NIL.", "\tXX,", "XX1", ""]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r[0] for r in df.select(references.last_number(F.col("v"))).collect()] == ["2", "7", None, None, "0", *[None] * 8, "1", None]
    assert [r[0] for r in df.select(references.given(F.col("v"))).collect()] == [True, True, True, False, True, *[False] * 8, True, False]


def test_citations_that_are_not_given_are_no_orphans(spark):
    """NA, and NIL. cite nothing; a text without any number is given and equals no tag."""
    weld = lambda i, v: (i, "d", "weld", f"W{i}", json.dumps({"spool_no": v}), None)
    tags = spark.createDataFrame([weld(1, "NA,"), weld(2, "NIL."), weld(3, "by others"), weld(4, "SP-7"), weld(5, "SP 8"), (6, "d", "spool", "07", "{}", None)], "id bigint, document_id string, tag_type string, tag_number string, attributes string, created_at timestamp")
    none = spark.createDataFrame([], "id string, document_id string, created_at timestamp")
    refs = references.citations(tags, none, none).filter("ref_field = 'spool_no'")
    docs = spark.createDataFrame([("d",)], "id string")
    assert sorted(r.row_id for r in references.orphans(refs, references.targets(docs, tags)).collect()) == ["3", "5"]


def test_equal_hashes_are_settled_by_key():
    import pandas as pd

    parents = pd.DataFrame({"range": 0, "salt": 0, "h": [5, 5, 7], "key": ["a", "b", "c"]})
    refs = pd.DataFrame({"range": 0, "salt": 0, "h": [5, 5, 7, 5], "key": ["b", "z", "c", "a"], "n": [1, 2, 3, 4]})
    assert list(references._probe((0, 0), refs, parents)["n"]) == [2]


def test_materialise_keeps_rows(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert materialise(df, "t").agg(F.sum("x")).first()[0] == 90
