"""Relational, spool, geometry, rule, source, sink and stream operators on literal rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoweave.operators import geometry, rules, spools
from isoweave.operators import relational as R
from isoweave.sources import pages, sinks
from isoweave.streaming import jobs


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_latest_and_merge(spark):
    t = dt.datetime
    df = spark.createDataFrame([("d", 1, t(2024, 1, 2)), ("d", 2, t(2024, 1, 1)), ("d", 3, None), ("e", 4, None), ("f", 5, t(2024, 1, 1)), ("f", 6, t(2024, 1, 1))], "k string, id int, at timestamp")
    assert rows(R.latest(df, ["k"], "at", "id"), "k", "id") == [("d", 1), ("e", 4), ("f", 6)]
    lines = spark.createDataFrame([("L", 2, 1, "200", "V-2"), ("L", 1, 2, "NA", "V-1"), ("L", 3, 3, "100", None)], "k string, page int, id int, size string, to string")
    assert rows(R.merge_lines(lines, ["k"], ["size", "to"], ["page", "id"], last=("to",))) == [("L", "200", "V-2", 3)]


def test_bands_keep_apart_what_is_not_adjacent(spark):
    df = spark.createDataFrame([("c", 0, "a", "1", "2"), ("c", 1, "a", "3", "4"), ("c", 2, None, "5", "6"), ("c", 3, None, "7", "8"), ("c", 4, "a", "9", "10")], "c string, pos int, m string, size_min string, size_max string")
    assert rows(R.bands(df, ["c"], "pos", ["m"]).filter("m is not null"), "first_pos", "last_pos", "rows", "size_min", "size_max") == [(0, 1, 2, "1", "4"), (4, 4, 1, "9", "10")]
    assert R.bands(df, ["c"], "pos", ["m"]).count() == 3 and R.bands(df.limit(0), ["c"], "pos", ["m"]).count() == 0


def test_overlaps_share_bounds(spark):
    df = spark.createDataFrame([("g", 0, "1/2", "2"), ("g", 1, "2", "4"), ("g", 2, "6", "8"), ("g", 3, None, "9")], "g string, pos int, lo string, hi string")
    assert rows(R.overlaps(df, ["g"], "lo", "hi", "pos"), "pos") == [(1,)]


def test_compact_ranges(spark):
    df = spark.createDataFrame([("p", "SW", n, f"SW{n:02d}") for n in (1, 2, 3, 4, 5, 6, 9, 9)] + [("p", "FW", 1, "FW01")], "p string, prefix string, num bigint, raw string")
    assert rows(R.compact_ranges(df, ["p"], "prefix", "num", "raw")) == [("p", "FW01, SW01-SW06, SW09")]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (None, 3)], "a bigint, b bigint")
    got = dict(map(tuple, R.components(e).collect()))
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100 and R.components(e.limit(0)).count() == 0


def test_citations(spark):
    df = spark.createDataFrame([("F12 G23 B11 joint",), ("item 9 elbow / ITEM 007 pipe",), (None,), ("none",), ("f12",)], "t string")
    got = [r[0] and [(c.raw, c.item_no, c.start) for c in r[0]] for r in df.select(spools.citations(F.col("t"))).collect()]
    assert got == [[("F12", "12", 0), ("G23", "23", 4), ("B11", "11", 8)], [("item 9", "9", 0), ("ITEM 007", "7", 15)], None, [], []]


def test_cited_items_and_gasket(spark):
    notes = spark.createDataFrame([(1, 7, "F12 G13"), (1, 8, "G9")], "page int, note_id int, note string")
    bom = spark.createDataFrame([(1, "13", 3, "GASKET"), (1, "13", 2, "GASKET"), (1, "12", 1, "Flange"), (1, "9", 4, "gasket")], "page int, item_no string, bom_id int, component_type string")
    c = spools.cited_items(notes, bom, ["page"])
    assert rows(c, "note_id", "item_no", "bom_id", "ambiguous") == [(7, "12", 1, False), (7, "13", 2, True), (8, "9", 4, False)]
    assert rows(spools.gasket_without_flange(c)) == [(8,)]


def test_flags(spark):
    df = spark.createDataFrame([("through the trunnion ball valve",), ("has a branch leg",), ("bounded by the branch leg",), (None,)], "n string")
    assert [r[0] for r in df.select(spools.boundary_flags(F.col("n"))).collect()] == [["through valve"], [], ["branch boundary"], []]
    w = spark.createDataFrame([(1, 1, "item 3 tee", "200"), (1, 2, "item 03 (tee", "200"), (1, 3, "item 4 weldolet", "50"), (1, 4, "item 4 weldolet", "80"), (1, 5, "item 5 tee", "80")], "page int, weld_id int, note string, size string")
    assert rows(spools.same_size_items(w, ["page"]), "weld_id") == [(1,), (2,)]


def test_clustered_sum(spark):
    d = spark.createDataFrame([("s", 1, 1407.0, "E874061", "x"), ("s", 2, 900.0, "y", "E874061"), ("s", 3, 100.0, "z", None), ("t", 4, 5.0, "E874061", None)], "s string, id int, v double, a string, b string")
    assert rows(spools.clustered_sum(d, ["s"], "id", "v", ["a", "b"])) == [("s", 1507.0), ("t", 5.0)]


def test_chains(spark):
    p = spark.createDataFrame([("l", 1, "SW01", "SW04"), ("l", 2, "SW01", "SW02"), ("l", 3, "SW09", "SW01")], "g string, piece_id int, from_ref string, to_ref string")
    d = spark.createDataFrame([("l", 11, "SW01", "SW02", 10.0), ("l", 12, "SW03", "SW02", 20.0), ("l", 13, "SW03", "SW04", 30.0), ("l", 14, "SW01", "SW02", 99.0)], "g string, dim_id int, from_ref string, to_ref string, value double")
    assert rows(spools.chains(p, d, ["g"])) == [("l", 1, [11, 12, 13], 60.0), ("l", 2, [11], 10.0)]


def test_orientation_is_the_best_of_six(spark):
    import itertools

    inner = (12032, 2390, 2350)
    boxes = [(5538.0, 2000.0, 1500.0), (2000.0, 11000.0, 2300.0), (9e9, 1.0, 1.0), (2350.0, 2350.0, 2350.0)]
    df = spark.createDataFrame([(list(b),) for b in boxes], "b array<double>")
    for b, r in zip(boxes, df.select(spools.orientation(F.col("b"), inner)).collect()):
        want = max(min(i - b[k] for i, k in zip(inner, p)) for p in itertools.permutations(range(3)))
        assert (r[0] is None) == (want < 0) and (want < 0 or r[0].clearance == want)


def test_symbols(spark):
    ring = [(10 + 6 * math.cos(a), 10 + 6 * math.sin(a)) for a in np.arange(0, 2.5 * math.pi, math.pi / 2)]
    assert geometry.diamond(np.array(ring))[0] == 0 and geometry.diamond(np.array([(40.0, 40.0), *ring]))[0] == 1
    tie = [(0.0, 0.0), (18.0, 6.0), (18.0, 0.0), (0.0, 6.0), (0.0, 3.0), (0.0, 0.0)]
    assert geometry.bowtie(np.array(tie)) is not None and geometry.bowtie(np.array(ring[:5])) is None
    df = spark.createDataFrame([("d", 1, 1, [list(p) for p in ring]), ("d", 1, 2, [list(p) for p in tie]), ("d", 1, 3, []), ("d", 1, 4, None)], "document_id string, page_number int, path_id bigint, points array<array<double>>")
    assert rows(geometry.symbols(df), "path_id", "kind") == [(1, "weld"), (2, "valve")]


def test_rules(spark):
    t = spark.createDataFrame([(1, "p", "iso", "line", "L-1", '{"size": "NA", "t": "30"}'), (2, "p", "pll", "line", "l-1 ", '{"size": "100", "t": "31.5"}'), (3, "p", "pll", "line", "L-1", '{"t": "99"}')], "id bigint, project_id string, doc_type string, tag_type string, tag_number string, attributes string")
    eq = {"check_type": "field_equality", "field": "t", "doc_type_a": "iso", "doc_type_b": "pll", "normalise": "numeric"}
    assert rows(rules.evaluate_equality(t, eq), "value_a", "value_b", "passed") == [("30", "31.5", False)]
    assert rows(rules.evaluate_equality(t, eq | {"tolerance": 2}), "passed") == [(True,)]
    got = rules.evaluate(t, [{"name": "s", "check_type": "field_presence", "required_field": "size"}, {"name": "e", "check_type": "custom_expression", "expression": "t < 40", "doc_types": ["pll"]}, {"name": "off", "check_type": "regex_format", "field": "t", "pattern": "x", "active": False}])
    assert rows(got, "rule", "id") == [("e", 3), ("s", 1), ("s", 3)]
    assert rules.validate({"check_type": "value_range"}) == ["value_range needs field"] and rules.validate({"check_type": "magic"})
    for bad in ("java_method('x')", "a; drop", "a -> b", "`a`"):
        with pytest.raises(ValueError):
            rules.compile_expression(bad)
    assert rules.evaluate(t, []).count() == 0


def test_sheet_pages(spark):
    a = "[Worksheet: W]\nSPREF\tSPEC OF X\tGTYPE\tCatalogue\tDetailing text\tMaterial text\tSize P1\tWeight\n/A/1\tA\tELBO\tc\td\tm\t100\t7\n\n/A/2\tA\t \tc"
    b = "[Worksheet: VALVES]\nItemCode\tSizes\tMaterial\n\t1x2\tm\n\t\tm"
    df = spark.createDataFrame([(1, a), (2, b), (3, None), (4, "one line\tonly"), (5, "x\ty\n1\t2")], "id bigint, page_text string")
    got = pages.sheet_rows(df).collect()
    assert [(r.id, r.type, r.reference, r.size_p1, r.size_p2) for r in sorted(got)] == [(1, "ELBO", "/A/1", "100", ""), (2, "VALVES", "1x2", "1x2", "")]
    assert [tuple(x) for x in next(r for r in got if r.id == 1).extra] == [("Weight", "7")]
    assert rows(spark.createDataFrame([("A.XLSX",), ("b.csv",), ("c.pdf",)], "f string").select(pages.page_kind(F.col("f")))) == [("csv",), ("pdf",), ("xlsx",)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("d1", 1), ("d2", 2)], "document_id string, n int")
    for _ in range(2):
        sinks.replace_partitions(df, path, "document_id")
    sinks.replace_partitions(df.filter("n = 2").withColumn("n", F.lit(5)), path, "document_id")
    assert rows(spark.read.parquet(path), "document_id", "n") == [("d1", 1), ("d2", 5)]
    fresh = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", "h", 3)], "p string, h string, x int")
    assert rows(sinks.new_rows(fresh, fresh.filter("x = 3"), ["p", "h"])) == [("a", None, 1)]
    old, new = spark.createDataFrame([(1, None), (2, "x")], "id int, f string"), spark.createDataFrame([(1, None), (2, None), (3, "y")], "id int, f string")
    assert rows(sinks.changed(old, new, "id", ["f"]), "id") == [(2,), (3,)]
    left = sinks.without_document({"project_documents": spark.createDataFrame([("d",), ("e",)], "id string"), "findings": spark.createDataFrame([("d", "e"), ("x", "d"), ("e", None)], "doc_a_id string, doc_b_id string")}, "d")
    assert left["project_documents"].count() == 1 and left["findings"].count() == 1
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_jobs(spark, tmp_path):
    now = dt.datetime(2024, 1, 1, 12)
    j = spark.createDataFrame([(1, "running", now - dt.timedelta(minutes=16), None), (2, "running", now - dt.timedelta(minutes=14), None), (3, "queued", None, None)], "id int, status string, started_at timestamp, error_message string")
    got = jobs.fail_stale(j, F.lit("2024-01-01 12:00:00").cast("timestamp"))
    assert rows(got, "id", "status") == [(1, "failed"), (2, "running"), (3, "queued")]
    ev = spark.createDataFrame([(1, now, "a"), (1, now + dt.timedelta(minutes=1), "b"), (2, now, None)], "job int, ts timestamp, s string")
    ev.write.parquet(str(tmp_path / "events.parquet"))
    assert rows(jobs.settle(jobs.job_states(jobs.read_events(spark, str(tmp_path)), "job", "ts", F.col("s")), ["job"], "t"), "job", "state", "events") == [(1, "b", 2)]
