"""Cross-checks against classes, staged findings, quality of isometrics: literal cases that the tables do not hold."""

import json

import pytest
from pyspark.sql import functions as F

from isoweave.functions import classify as K
from isoweave.operators import crosscheck as C
from isoweave.operators import extract as E
from isoweave.operators import gates as G
from isoweave.operators import quality as Q
from isoweave.operators import tenancy

TAG = "id bigint, project_id string, document_id string, doc_type string, tag_type string, tag_number string, attributes string, extra int"


def tags(spark, rows):
    return spark.createDataFrame([(i, "p", doc, dt, tt, n, a if a is None or isinstance(a, str) else json.dumps(a), 0) for i, doc, dt, tt, n, a in rows], TAG)


def row(kind, lo, hi, **more):
    return {"fitting_type": kind, "size_min": lo, "size_max": hi, **more}


CLASS = {
    "fittings": [row("Tee (Straight)", "15", "100"), row("Elbow", "15", "100", material="A234"), row("Elbow", "150", "300"), row("Tee (Reduced)", "15", "300"), "note"],
    "flanges": [{"flange_type": "Flange", "class": "150", "size_min": "15", "size_max": "600"}, {"flange_type": "Flange", "class": "300", "size_min": "15", "size_max": "600"}, {"flange_type": "Blind flange", "size_min": "15", "size_max": "250"}, {"flange_type": "Stud Bolt"}],
    "valves": [{"valve_type": "Ball", "size_min": "15", "size_max": "50"}, {"valve_type": "Check", "size_min": "15", "size_max": "50"}],
    "resolved_branches": [{"header_size": "100", "branch_size": "50", "material": "A105", "code": "W"}, {"header_size": "150", "branch_size": "50", "material": None}],
}


def classes(spark):
    rows = [(1, "s", "spec_sheet", "spec_class", "AC03N", {"pipes": []}), (2, "s", "spec_sheet", "spec_class", "ac03n ", CLASS), (3, "s", "spec_sheet", "spec_class", "BC70N", "{"), (4, "s", "spec_sheet", "spec_class", None, CLASS)]
    return C.class_table(tags(spark, rows))


def test_classes_of_the_richest_tag(spark):
    got = {r.class_code: r for r in classes(spark).collect()}
    assert set(got) == {"AC03N", "BC70N"} and got["AC03N"].id == 2 and got["BC70N"].fittings == []
    assert [r.pos for r in got["AC03N"].fittings] == [0, 1, 2, 3]


def test_bill_rows_meet_rows_of_their_type(spark):
    """An elbow of a size that a tee row has too goes to the elbow's row."""
    bom = spark.createDataFrame([
        (1, "AC03N", "FITTING", "ELBOW 90", 100.0), (2, "AC03N", "FITTING", "REDUCING TEE", 100.0), (3, "AC03N", "FITTING", "ELBOW", 600.0), (4, "AC03N", "FLANGE", "BLIND FLANGE", 250.0), (5, "AC03N", "FLANGE", "FLANGE WN", 300.0),
        (6, "ZZ", "FITTING", "TEE", 50.0), (7, "AC03N", "GASKET", "GASKET", 50.0), (8, "AC03N", "PIPE", "PIPE", 50.0), (9, "AC03N", "VALVE", "CHECK VALVE", 50.0), (10, None, "VALVE", "VALVE", None), (11, "AC03N", "VALVE", "VALVE", None),
    ], "id int, class_code string, component_type string, description string, dn double")
    left = bom.select("id", "class_code", C.bom_hint(K.bom(F.col("component_type"), F.col("description"))).alias("hint"), "dn")
    got = {r.id: (r.verdict, r.category, r.pos) for r in C.check_bom(left, classes(spark)).collect()}
    assert got == {
        1: ("match", "fittings", 1), 2: ("match", "fittings", 3), 3: ("not_found", None, None), 4: ("match", "flanges", 2), 5: ("match", "flanges", 0), 6: ("class_not_found", None, None), 7: ("out_of_scope", None, None),
        8: ("no_client_data", None, None), 9: ("match", "valves", 1), 10: ("class_not_found", None, None), 11: ("size_unrecognized", None, None),
    }
    assert C.check_bom(left.limit(0), classes(spark)).count() == 0


ITEM = "id int, class_code string, type string, description string, material string, size_p1 string, size_p2 string"
ITEMS = [
    (1, "AC03N", "ELBO", "ELBOW 90", None, "100", ""), (2, "AC03N", "FLAN", "FLANGE WN 300#", "", "100", ""), (3, "AC03N", "FBLI", "BLIND", "", "300", ""), (4, "AC03N", "BOLT", "STUD BOLT", "", "", None), (5, "AC03N", "TEE", "EQUAL TEE", "", "100", "50"),
    (6, "AC03N", "TEE", "REDUCING TEE", "", "100", "80"), (7, "AC03N", "TEE", "TEE", "", "150", "50"), (8, "AC03N", "VALV", "CHECK VALVE, BALL LIFT", "", "50", ""), (9, "AC03N", "CAP", "CAP", "", "100", ""), (10, "AC03N", "ELBO", "ELBOW", "", "33", ""),
    (11, "AC03N", "ATTA", "SHOE", "", "100", ""), (12, "XX", "ELBO", "ELBOW", "", "100", ""), (13, "AC03N", None, None, None, None, None), (14, "AC03N", "CAP", "CAP", "", "750", ""), (15, "AC03N", "TUBE", "PIPE", "", "50", ""),
]


def test_item_verdicts(spark):
    got = {r.id: (r.verdict, r.pos) for r in C.check_items(spark.createDataFrame(ITEMS, ITEM), classes(spark)).collect()}
    assert got == {
        1: ("match", 1), 2: ("match", 1), 3: ("not_found", None), 4: ("match", 3), 5: ("match", None), 6: ("not_found", None), 7: ("no_client_data", None), 8: ("match", 1), 9: ("mismatch", 0), 10: ("size_unrecognized", None),
        11: ("out_of_scope", None), 12: ("class_not_found", None), 13: ("out_of_scope", None), 14: ("not_found", None), 15: ("no_client_data", None),
    }


def test_items_beside_rows_and_bands(spark):
    got = sorted((r.id, r.category, r.pos, r.label) for r in C.substantiated(spark.createDataFrame(ITEMS, ITEM), classes(spark)).filter("pos is null or category = 'flanges'").collect() if r.id < 9)
    assert got == [(2, "flanges", 1, "Flange"), (3, "flanges", None, "Blind flange"), (4, "flanges", 3, "Stud Bolt")]
    bands = {(r.category, r.band): (r.type, r.positions, r.size_min, r.size_max) for r in C.class_bands(classes(spark)).collect()}
    assert bands["fittings", 1] == ("Elbow", [1], "15", "100") and bands["fittings", 2] == ("Elbow", [2], "150", "300")
    assert bands["flanges", 0][1] == [0] and bands["flanges", 1][1] == [1]


def test_stages_stop_the_document(spark):
    line = lambda i, doc, n, **a: (i, doc, "iso", "line", n, {"document_number": "D", "drawing_number": "G", "revision": "0", "sheet": "1", **a})
    listed = lambda i, n, **a: (i, "l", "pll", "line", n, a)
    rows = [
        line(1, "a", "100-HV-AC03N-1", size="100", spec_class="AC03N", design_pressure="10 barg", slope="1:100"), line(2, "a", "100-HV-AC03N-2"), line(3, "b", "100-HV-AC03N-9"), line(4, "b", "100-HV-AC03N-1", spec_class="ZZ99Z"),
        line(5, "c", "100-HV-AC03N-2", spec_class="BC70N"), line(6, "c", "100-HV-AC03N-1", size="200"), line(7, "d", "100-HV-AC03N-1", size="100", spec_class="AC03N", spec_breaks=[{"spec_class": "AC03N", "rating": "150"}, {"spec_class": "QQ11Q", "rating": "300"}]),
        listed(20, "100-HV-AC03N-1 ", size="100 mm", spec_class="AC03N", design_pressure="1000 kpag"), listed(21, "100-HV-AC03N-1", size="50"), listed(22, "100-hv-ac03n-2", spec_class="AC03N"),
        (30, "g", "ga", "line", "100-HV-AC03N-2", {}), (31, "q", "pid", "line", "100-HV-AC03N-1", {}), (32, "s", "spec_sheet", "spec_class", "AC03N", {}),
        (40, "d", "iso", "bom_item", "1", {"component_type": "FLANGE", "description": "FLANGE 150#", "line_number": "100-HV-AC03N-1"}), (41, "d", "iso", "bom_item", "2", {"component_type": "PIPE SUPPORT", "description": "shoe"}), (42, "b", "iso", "bom_item", "3", {"component_type": "SUPPORT", "description": "shoe"}),
        (43, "d", "iso", "bom_item", "4", {"component_type": "support", "description": "PS01 guide"}), (44, "d", "iso", "bom_item", "5", None),
    ]
    got = {}
    for r in G.findings(tags(spark, rows)).collect():
        got.setdefault((r.document_id, r.tag_id), set()).add(r.field_checked)
    assert got["a", 1] == {"1.duplicates", "8.line_routing"} and got["a", 2] == {"3.line_on_pid"}
    assert got["b", 3] == {"1.line_exists"} and got["b", 4] == {"1.duplicates", "1.decode_class"} and ("b", 42) not in got
    assert got["c", 5] == {"1.decode_class", "2.piping_class"} and got["c", 6] == {"1.duplicates", "1.decode_size", "1.size"}
    assert got["d", 7] == {"1.duplicates", "8.line_routing", "4.break_spec_class", "4.break_flange_rating"} and got["d", 41] == {"6.support_type"} and ("d", 43) not in got
    basis = {r.field: r.status for r in G.design_basis(tags(spark, rows)).filter("tag_id = 1").collect()}
    assert len(basis) == 14 and basis["Size"] == "mismatch" and basis["Design pressure"] == "not compared"
    alone = G.findings(tags(spark, rows[:2])).filter("field_checked = '1.line_exists'").collect()
    assert [(r.tag_id, r.severity) for r in alone] == [(1, "info")] and G.findings(tags(spark, [])).count() == 0


def test_valve_match(spark):
    bom = spark.createDataFrame([("k", 1, "VALVE", "GATE VALVE, FLGD", "AC03N-N", "2\"", "2"), ("k", 2, "VALVE", "GATE VALVE, SW", "AC03N", "2\"", None), ("k", 3, "VALVE", "BALL VALVE", None, None, "1"), ("k", 4, "PIPE", "PIPE", "AC03N", "2\"", "9")], "k string, id int, component_type string, description string, item_spec_class string, size string, quantity string")
    pid = spark.createDataFrame([("k", 1, "gate", "AC03N", "2\"", "3", "V-1"), ("k", 2, "gate", "AC03N", "2\"", "0", " "), ("k", 3, "check", "AC03N", "2\"", "1", None)], "k string, id int, valve_type string, spec_class string, size string, quantity string, tag_number string")
    got = {(r.spec_class, r.category): r for r in Q.valve_match(bom, pid, ["k"]).collect()}
    g = got["AC03N", "gate"]
    assert (g.iso_count, g.pid_count, g.status, g.iso_detail, g.pid_detail, g.dn, g.place) == (3.0, 3.0, "match", "GATE VALVE", "V-1", 50, 2)
    c = got["AC03N", "check"]
    assert (c.status, c.pid_detail, c.place, c.iso_total, c.pid_total) == ("pid only", "untagged", 1, 3.0, 4.0)
    assert got["unassigned", "ball"].class_place == 2 and len(got) == 3


def test_flags(spark):
    welds = spark.createDataFrame([("s", 1, "SW 01", "S1", "Field Weld", "7 ", "2", ""), ("s", 2, "FW02", "S1", "field weld", None, None, None), ("s", 3, "sw01", "S2", "shop", "9", "2", None)], "g string, id int, tag_number string, spool_no string, weld_type string, weld_list_id string, size string, location_note string")
    spools = spark.createDataFrame([("s", 1, "S1", "bounded by a branch leg"), ("s", 2, "S2", "through the gate valve"), ("s", 3, "S3", None)], "g string, id int, spool_no string, note string")
    assert sorted((r.id, r.flag, r.a) for r in Q.spool_flags(spools, welds, ["g"]).collect()) == [(1, "branch boundary", None), (1, "field welds", "2"), (2, "through valve", None)]
    dims = spark.createDataFrame([("s", 1, "S1", "from SW01", "FW02"), ("s", 2, "S2", "sw 1", "SW 01"), ("s", 3, "S2", "FW2", "FW02 end"), ("s", 4, None, "SW01", None)], "g string, id int, spool_no string, from_ref string, to_ref string")
    assert sorted((r.id, r.tag, r.weld_spool) for r in Q.dimension_flags(dims, welds, ["g"]).collect()) == [(1, "SW01", "S2"), (3, "FW02", "S1")]
    rows = spark.createDataFrame([("s", 1, "7", "2", "SHOP"), ("s", 2, " 7", "3", "FIELD"), ("s", 3, "9", "2 ", None)], "g string, id int, number string, nd string, type string")
    assert [(r.id, r.size_differs, r.place_differs) for r in Q.weld_list_flags(welds, rows, ["g"]).collect()] == [(1, True, False)]


def test_container_fit(spark):
    dims = spark.createDataFrame([
        ("d", 1, "SP 01", "E", "4000", "SW1", "SW2", False), ("d", 2, "01", " e ", "3000", "SW2", None, False), ("d", 3, "S-1", "N", "2000", None, None, False), ("d", 4, "1", "N", "100", None, None, False), ("d", 5, "1", "EL", "99999", None, None, True),
        ("d", 6, "2", "E", "13000", None, None, False), ("d", 7, "3", "up", "5", None, None, False), ("d", 8, "3", "E", "-5", None, None, False), ("d", 9, None, "E", "5", None, None, False),
    ], "g string, id int, spool_no string, axis string, value string, from_ref string, to_ref string, excluded boolean")
    points = spark.createDataFrame([("d", "4", 0.0, 0.0, 0.0), ("d", "04", 100.0, 50.0, 2380.0), ("d", "5", 1.0, 1.0, 1.0)], "g string, spool_no string, e double, n double, el double")
    over = spark.createDataFrame([("d", "2", "E", 11000.0), ("d", "9", "E", 1.0)], "g string, spool_no string, axis string, value double")
    got = {r.spool: r for r in Q.container_fit(dims, points, ["g"], over).collect()}
    assert set(got) == {"1", "2", "4"}
    assert (got["1"].e, got["1"].n, got["1"].el, got["1"].container) == (4000.0, 2100.0, 0.0, "20ft")
    assert (got["2"].e, got["2"].container) == (11000.0, "40ft") and (got["4"].el, got["4"].container) == (2380.0, "20ft")
    assert {r.spool: r.container for r in Q.container_fit(dims, points, ["g"]).collect()}["2"] == "oversized"


def test_class_tables(spark):
    rows = Q.mended_rows(classes(spark))
    assert [(r.category, r.pos, r.before) for r in Q.overlapping(rows).collect()] == []
    bad = tags(spark, [(1, "s", "spec_sheet", "spec_class", "AC03N", {"fittings": [row("Elbow", "2", "4"), row("Cap", "1", "9"), row("Elbow", "1", "2"), row("Elbow", "1", "1/2"), row("Elbow", None, "8")], "valves": [{"valve_type": "Ball", "size_min": "1", "size_max": "4"}] * 2})])
    m = Q.mended_rows(C.class_table(bad))
    assert [(r.pos, r.before, r.issue) for r in Q.overlapping(m).collect()] == [(3, 2, "Elbow 1-2 overlaps Elbow 1 1/2")]
    assert {r.pos: r.place for r in Q.sorted_rows(m).filter("category = 'fittings'").collect()} == {2: 1, 3: 2, 0: 3, 4: 4, 1: 5}
    assert [r.pos for r in m.filter("repaired").collect()] == [3]
    notes = spark.createDataFrame([("A", "see Note a and note-B"), ("A", None)], "class_code string, notes string")
    legend = spark.createDataFrame([("A", "B "), ("A", "c"), ("A", "")], "class_code string, letter string")
    assert sorted((r.letter, r.issue) for r in Q.note_issues(notes, legend).collect()) == [("a", "not in the legend"), ("c", "not cited")]


def test_extraction_forms(spark):
    sheet = {"pageNumber": 4, "drawing_number": "G1", "result": json.dumps({"line_number": "100-HV-AC03N-1\nSHEET 2", "size": "100", "spec_breaks": [{"spec_class": "A", "rating": "150#"}, {"spec_class": "B", "rating": "300"}], "welds": [{"weld_tag": None}, "x", {"weld_tag": "SW\n1"}], "spools": [{"spool_no": " "}, {"spool_no": "S1"}], "bom_items": {"item_no": "1", "description": "FLANGE 300#"}, "route_points": [{}]})}
    df = spark.createDataFrame([("r", "d", json.dumps({"sheets": [sheet, {"result": None}, "x"]})), ("u", "d", "{"), ("n", None, None)], "id string, document_id string, raw_json string")
    got = {(r.tag_type, r.pos): r for r in E.iso_tags(df).collect()}
    assert {k: v.tag_number for k, v in got.items()} == {("line", 0): "100-HV-AC03N-1 / SHEET 2", ("weld", 0): "W4-1", ("weld", 2): "SW / 1", ("spool", 1): "S1", ("bom_item", 0): "1", ("route_point", 0): "RP4-1"}
    assert got["bom_item", 0].attributes["item_spec_class"] == "B" and got["bom_item", 0].attributes["item_spec_basis"] == "rating"
    assert got["line", 0].attributes["size"] == "100 mm" and got["weld", 0].page == 4
    assert E.iso_tags(df.limit(0)).count() == 0


def test_members(spark):
    projects = spark.createDataFrame([("p1", "o1"), ("p2", "o2"), ("p3", None)], "id string, organization_id string")
    members = spark.createDataFrame([("o1", "u"), ("o1", "u"), (None, "u")], "organization_id string, user_id string")
    rows = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3"), (4, None)], "id int, project_id string")
    assert [r.id for r in tenancy.visible(rows, projects, members, "u").collect()] == [1]
    tenancy.require_member(projects, members, "p1", "u")
    for p in ("p2", "p3", "none"):
        with pytest.raises(PermissionError):
            tenancy.require_member(projects, members, p, "u")
