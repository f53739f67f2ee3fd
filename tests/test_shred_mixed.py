"""Records whose forms differ: one row never decides for the others."""

import json

import pytest

from isoweave.operators import shred
from isoweave.plans.core_problems import QUERIES, TAG_CHILDREN


def sheets_folder(spark, path, texts):
    spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "id string, raw_json string").write.parquet(f"{path}/extraction_results.parquet")
    spark.createDataFrame([], "id bigint, tag_type string, attributes string").write.parquet(f"{path}/extracted_tags.parquet")
    return str(path)


def test_one_result_as_array_leaves_the_others(spark, tmp_path):
    result = lambda n: {"welds": [{"t": n}, "note", {"t": n + 1}], "bom_items": {"n": n}}
    sheets = [{"result": result(0)}, {"result": [result(10), None, result(20)]}, {"result": json.dumps([result(30)])}, {"result": json.dumps(result(40))}, {"result": "see sheet 2"}]
    d = sheets_folder(spark, tmp_path, [json.dumps({"sheets": sheets}), json.dumps({"sheets": sheets[0]})])
    got = sorted((r.parent_id, r.sheet_pos, r.child, r.child_pos) for r in QUERIES["p1_found"](spark, d).collect())
    one = lambda p, s: [(p, s, "bom_items", 0), (p, s, "welds", 0), (p, s, "welds", 2)]
    assert got == sorted(one("r0", 0) + one("r0", 1) * 2 + one("r0", 2) + one("r0", 3) + one("r1", 0))
    welds = sorted((r.id, r.t, tuple(int(x) for x in r.parent_pos.split(".") if x)) for r in QUERIES["p1_welds"](spark, d).filter("t is not null").collect())
    assert [(t, o) for i, t, o in welds if i == "r0"] == [(0, (0,)), (1, (0,)), (10, (1, 0)), (11, (1, 0)), (20, (1, 2)), (21, (1, 2)), (30, (2, 0)), (31, (2, 0)), (40, (3,)), (41, (3,))]


def test_wide_objects_keep_the_way_to_names_asked_for(spark):
    wide = {f"k{i}": 1 for i in range(30)} | {"result": {"welds": [{"t": 1}]}}
    df = spark.createDataFrame([("a", json.dumps({"sheets": [wide]}))], "id string, raw string")
    s = shred.shred(df, "raw", ["id"], root="sheets", only={"welds"}, max_fields=20)
    assert [(r.level, tuple(r.ords)) for r in s.rows.collect()] == [("sheets/result.welds", (0, 0))]


def test_scalars_of_two_forms_stay_a_column(spark, tmp_path):
    items = [{"size": "2 in", "n": 1}, {"size": 50, "n": 2}, {"size": {"dn": 50}, "n": 3}, {"size": [1, 2], "n": 4}]
    d = sheets_folder(spark, tmp_path, [json.dumps({"sheets": [{"result": {"bom_items": [i]}}]}) for i in items])
    assert {r.n: r["size"] for r in QUERIES["p1_bom_items"](spark, d).collect()} == {1: "2 in", 2: "50", 3: '{"dn":50}', 4: "[1,2]"}
    df = spark.createDataFrame([("a", json.dumps({"items": items}))], "id string, raw string")
    s = shred.shred(df, "raw", ["id"], root="items")
    assert {r.n: r["size"] for r in s.flat("items").collect()} == {1: "2 in", 2: "50", 3: None, 4: None}
    assert sorted(tuple(r.ords) for r in s.rows.filter("level = 'items/size'").collect()) == [(2, 0), (3, 0), (3, 1)]


def test_wide_objects_keep_their_scalars(spark):
    df = spark.createDataFrame([("a", json.dumps({"items": [{f"k{i}": i for i in range(30)} | {"m": [1]}]}))], "id string, raw string")
    r = shred.shred(df, "raw", ["id"], root="items", max_fields=20).flat("items").first()
    assert r.k0 == 0 and r.k29 == 29


def test_tag_children_are_flat_tables_and_the_walk_goes_down(spark, tmp_path):
    bag = {c: [{"size": c, "ends": [{"e": 1}, {"e": 2}]}, "note"] for c in TAG_CHILDREN}
    tags = [(1, "spec_class", json.dumps(bag)), (2, "line", json.dumps({"spec_breaks": {"size": "lone"}})), (3, "line", "{")]
    spark.createDataFrame(tags, "id bigint, tag_type string, attributes string").write.parquet(f"{tmp_path}/extracted_tags.parquet")
    for c in TAG_CHILDREN:
        got = sorted((r.id, r.pos, r["size"], r.ends, r.scalar_text) for r in QUERIES[f"p1_{c}"](spark, str(tmp_path)).collect())
        assert got[:2] == [(1, 0, c, '[{"e":1},{"e":2}]', None), (1, 1, None, None, "note")] and len(got) == 2 + (c == "spec_breaks")
    deep = QUERIES["p1_tag_elements"](spark, str(tmp_path)).filter("level like '%/ends'").collect()
    assert sorted((r.level, tuple(int(x) for x in r.parent_pos.split(".") if x), r.pos, r.element) for r in deep) == sorted((f"$/{c}/ends", (0,), i, f'{{"e":{i + 1}}}') for c in TAG_CHILDREN for i in (0, 1))


def test_the_walk_goes_down_to_the_last_level(spark):
    deep = {"t": 6}
    for _ in range(6):
        deep = {"a": [deep]}
    df = spark.createDataFrame([("x", json.dumps(deep))], "id string, raw string")
    assert [r.t for r in shred.shred(df, "raw", ["id"]).flat("$" + "/a" * 6).collect()] == [6]
    with pytest.raises(ValueError):
        shred.shred(df, "raw", ["id"], max_depth=4)
