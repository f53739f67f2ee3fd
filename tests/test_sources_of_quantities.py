"""Problem 2 over all its sources: sheets are converted, and linked with the design basis and line lists for the estimates."""

import json

from isoweave.plans.core_problems import QUERIES


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_sheet_values_are_converted_and_teach_units(spark, tmp_path):
    """A spelling that stands on sheets only is learnt from the line list and design basis values of the same line."""
    d, sheets, basis, tags = str(tmp_path), [], [], []
    for i in range(40):
        line, bar = f"L-{i}", 10.0 + i
        result = {"line_number": line, "hydrotest_pressure": f"{bar / 0.0689476:.4f} zorks", "design_temperature": "373.15 K", "insul_thickness_mm": 5 if i else None}
        sheets.append({"result": result if i % 3 else json.dumps(result) if i % 2 else [result]})
        if i % 2:
            basis.append((i, "p", "doc", line, "TEST PRESSURE", None, f"{bar:.4f}", None))
        else:
            tags.append((i, "p", "list", "pll", "line", line, json.dumps({"test_pressure": f"{bar:.4f} barg"})))
    save(spark, d, "extraction_results", [("r", "doc", json.dumps({"sheets": sheets})), ("bad", "doc", '{"sheets": [{'), (None, None, None)], "id string, document_id string, raw_json string")
    save(spark, d, "design_basis", basis, "id bigint, project_id string, document_id string, line_number string, field string, iso_value string, pll_value string, remarks string")
    save(spark, d, "extracted_tags", tags, "id bigint, project_id string, document_id string, doc_type string, tag_type string, tag_number string, attributes string")
    save(spark, d, "project_documents", [("doc", "p")], "id string, project_id string")
    got = QUERIES["p2_sheet_values"](spark, d).collect()
    assert len(got) == 119 and {r.result_id for r in got} == {"r"}
    pressure = {r.sheet_pos: r.common for r in got if r.field == "hydrotest_pressure"}
    assert all(abs(pressure[i] - 10 - i) < 0.001 for i in range(40))
    assert {r.common for r in got if r.quantity == "temperature"} == {100.0} and {r.common for r in got if r.quantity == "length"} == {5.0}
    u = {r.unit: r for r in QUERIES["p2_units"](spark, d).collect()}
    assert u["zorks"].basis == "estimated" and abs(u["zorks"].scale - 0.068948) < 1e-6
