"""Golden cases of the scalar functions and classifiers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isoweave.functions import classify as K
from isoweave.functions import compare as C
from isoweave.functions import sizes as S
from isoweave.functions import text as T


def run(spark, values, col):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(col(F.col("v"))).collect()]


def test_tag_key_keeps_hyphens(spark):
    assert run(spark, ["l-1024 ", "L 1024", " x\t", None], T.tag_key) == ["L-1024", "L 1024", "X", None]
    assert run(spark, ["L-1024", "L 1024"], lambda v: T.tag_key(v, T.LOOSE)) == ["L1024", "L1024"]


def test_slope(spark):
    assert run(spark, ["1 IN 100", "1/100", "SLOPE 1:100 TOWARDS V-101", "FREE DRAINING", " ", None], T.slope) == ["1:100", "1:100", "1:100", "FREE DRAINING", None, None]


def test_blank(spark):
    assert run(spark, ["XX.XX", "NIL.", "-", "XX barg", "X", "na", "", None, "Xenon", "10"], T.blank) == [True] * 8 + [False, False]


def test_line_parts(spark):
    rows = run(spark, ["350-HV-1S3F-A100-HC-NT", '12PGL03-2"-150JY11-C25', "1-2-3", None], T.line_parts)
    assert tuple(rows[0]) == ("350 mm", 350.0, "HV", "1S3F", "A100", "HC", "NT")
    assert rows[1:] == [None, None, None]


def test_ratings(spark):
    got = run(spark, ["FLANGE WN ASME B16.5 150# RF", "GASKET, SPIRAL WD, 300#", "150RF-FA", "CL150", "CLASS 300", "175#", None], T.rating)
    assert got == [150, 300, 150, None, None, None, None]


def test_classes(spark):
    assert run(spark, ["AC03N1"], T.class_code) == ["AC03N"]
    assert run(spark, ["AC03N-N", "XX", None], T.class_stem) == ["AC03N", None, None]


def test_sizes(spark):
    assert run(spark, ["36", "1.5", "1.1/2", '1 1/2"', "3/4", "abc", "", None], S.nps) == [36, 1.5, 1.5, 1.5, 0.75, None, None, None]
    got = run(spark, ['8"', '3/4"', "200 mm", '8" x 6"', "25 mm", "40", '26"', "", None], S.dn)
    assert got == [200, 20, 200, 200, 635, 1016, 660, None, None]
    assert run(spark, ["50", "65", "51", "", None], S.nps_of_dn) == [2.0, 2.5, None, None, None]
    df = spark.createDataFrame([(1.5,), (0.75,), (8.0,), (None,)], "v double")
    assert [r[0] for r in df.select(S.nps_label(F.col("v"))).collect()] == ["1 1/2", "3/4", "8", None]
    df = spark.createDataFrame([(200,), (203,), (40,), (None,)], "v int")
    assert [r[0] for r in df.select(S.dn_label(F.col("v"))).collect()] == ['8" (DN200)', "DN203", '1.5" (DN40)', "unsized"]


def test_mended_range(spark):
    df = spark.createDataFrame([("1", "1/2"), ("1/2", "2"), (None, "2")], "a string, b string")
    assert [tuple(r[0]) for r in df.select(S.mended_range(F.col("a"), F.col("b"))).collect()] == [("1 1/2", "1 1/2", True), ("1/2", "2", False), (None, "2", False)]


def test_verdicts(spark):
    rows = [("5 kPag", "0.05 barg", "match"), ("350", "350 mm", "match"), ("AMB.", "30 °C", "mismatch"), ("-", "30", "not compared"), ("10 °C", "50 °F", "mismatch"), (None, None, "not compared")]
    df = C.prepared(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, want string"), "a", "b")
    assert [(r[0]) for r in df.orderBy("i").select(C.verdict(True)).collect()] == [r[2] for r in rows]


@pytest.mark.parametrize(
    ("component", "description", "want"),
    [("INSTRUMENT", "control valve FV-0003", "valves"), ("X", "REDU CONC ASME B16.9", "reducers"), ("", "BLIND FLANGE", "flanges"), ("FITTINGS", "thing", "other fittings"), ("SUPPORT", "shoe", None), (None, None, None)],
)
def test_fitting(spark, component, description, want):
    df = spark.createDataFrame([(component, description)], "c string, d string")
    assert df.select(K.fitting(F.col("c"), F.col("d"))).first()[0] == want


def test_valve_and_bom(spark):
    assert run(spark, ["gate valve, ball type handle", "CHECK VALVE, BALL LIFT TYPE", "", None, "nozzle"], K.valve) == ["gate", "check", None, None, None]
    df = spark.createDataFrame([("", "BLIND FLANGE W/ BOLT HOLES"), ("", "STUD BOLT M16"), ("", "REDUCING TEE"), ("VALVE", "")], "c string, d string")
    assert [r[0] and tuple(r[0]) for r in df.select(K.bom(F.col("c"), F.col("d"))).collect()] == [("flanges", "blind"), None, ("fittings", "reduced"), ("valves", "")]


def test_dimension_ends(spark):
    got = run(spark, ["BW06 / item 7 ball valve region", "spectacle blind item 8 / F12 G23 B11 joint", "item 13", "elbow", "cont. on sheet 2", None], K.dimension_end)
    assert got == ["weld", None, "valve", "fitting", "tie-in", None]


def test_tokens(spark):
    assert run(spark, ["FLANGE RF WN ASME B16.5 API 600", "none", None], T.end_type) == ["WN", None, None]
    assert run(spark, ["pipe SCH 40S", "SCHEDULE XXS", "x"], T.schedule) == ["40S", "XXS", None]


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 48 * 8))
def test_size_label_round_trip(spark, eighths):
    v = spark.createDataFrame([(eighths / 8,)], "v double").select(S.nps_label(F.col("v")).alias("t"))
    assert v.select(S.nps(F.col("t"))).first()[0] == eighths / 8
