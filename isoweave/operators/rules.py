"""Declarative rules over tags: equality across documents, presence, range, format, and a closed expression language."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, tag_key, trimmed

REQUIRED = {
    "field_equality": ("field", "doc_type_a", "doc_type_b"),
    "field_presence": ("required_field",),
    "value_range": ("field",),
    "regex_format": ("field", "pattern"),
    "custom_expression": ("expression",),
}
_TOKENS = re.compile(r"\s*(?:(?P<name>[a-z_][a-z0-9_]*)|(?P<number>\d+(?:\.\d+)?)|(?P<text>'[^'\\]*')|(?P<op><=|>=|<>|!=|=|<|>|\+|-|\*|/|\(|\)|,))", re.I)
_WORDS = {"and", "or", "not", "is", "null", "like", "in", "between", "true", "false"}


def validate(rule: dict) -> list[str]:
    """Problems of a rule; an empty list if it can be evaluated."""
    kind = rule.get("check_type")
    if kind not in REQUIRED:
        return [f"unknown check_type {kind!r}"]
    out = [f"{kind} needs {f}" for f in REQUIRED[kind] if not rule.get(f)]
    if kind == "custom_expression" and not out:
        try:
            compile_expression(rule["expression"])
        except ValueError as e:
            out.append(str(e))
    return out


def attribute(path: str) -> Column:
    """Text of an attribute by dotted path."""
    if not re.fullmatch(r"\w+(\.\w+)*", path):
        raise ValueError(f"no attribute path: {path!r}")
    return F.get_json_object("attributes", "$." + path)


def compile_expression(text: str) -> Column:
    """A condition over attributes: names, numbers, quoted texts, comparisons, arithmetic and logic; no functions."""
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError(f"not allowed at {text[at : at + 10]!r}")
        if m["name"] and m["name"].lower() not in _WORDS and re.match(r"\s*\(", text[m.end() :]):
            raise ValueError(f"no function may be called: {m['name']}")
        found.append((m.lastgroup, m[0].strip()))
        at = m.end()
    kind = lambda i: found[i][0] if 0 <= i < len(found) else ""
    word = lambda i: found[i][1].lower() if 0 <= i < len(found) else ""
    compares = {"<", ">", "<=", ">=", "=", "<>", "!=", "between"}
    out = []
    for i, (k, t) in enumerate(found):
        if k == kind(i - 1) == "op" and t not in "(),+-" and word(i - 1) not in "(),":
            raise ValueError(f"no operator may follow {found[i - 1][1]!r}: {t!r}")
        if k != "name" or t.lower() in _WORDS:
            out.append(t)
            continue
        # An attribute is a number beside arithmetic or compared with a number, else a text.
        numeric = word(i + 1) in {"+", "-", "*", "/"} or word(i - 1) in {"+", "-", "*", "/"} or (word(i + 1) in compares and kind(i + 2) == "number") or (word(i - 1) in compares and kind(i - 2) == "number")
        value = f"get_json_object(attributes, '$.{t}')"
        out.append(f"try_cast({value} as double)" if numeric else value)
    try:
        return F.expr(" ".join(out))
    except Exception as e:
        raise ValueError(f"no condition: {text!r}") from e


def _prepare(v: Column, how: str) -> Column:
    return v.try_cast("double").cast("string") if how == "numeric" else F.upper(trimmed(v))


def evaluate_equality(tags: DataFrame, rule: dict) -> DataFrame:
    """(project_id, tag_key, value_a, value_b, passed): groups with a tag of either document type, the first of each."""
    field, how, tol = rule["field"], rule.get("normalise", "trim_upper"), float(rule.get("tolerance", 0))
    t = tags.select("id", "project_id", "doc_type", tag_key(F.col("tag_number")).alias("tag_key"), attribute(field).alias("v"))
    sides = [
        t.filter(F.col("doc_type") == rule[f"doc_type_{s}"]).groupBy("project_id", "tag_key").agg(F.min(F.struct("id", "v")).alias(s)).select("project_id", "tag_key", F.col(f"{s}.v").alias(f"value_{s}"))
        for s in ("a", "b")
    ]
    a, b = F.col("value_a"), F.col("value_b")
    same = F.abs(a.try_cast("double") - b.try_cast("double")) <= tol if how == "numeric" else _prepare(a, how) == _prepare(b, how)
    return sides[0].join(sides[1], ["project_id", "tag_key"]).filter("value_a is not null and value_b is not null").select("project_id", "tag_key", "value_a", "value_b", F.coalesce(same, F.lit(False)).alias("passed"))


def failing(rule: dict) -> Column:
    """Condition of the tags that break a rule on single tags."""
    kind = rule["check_type"]
    if kind == "field_presence":
        applies = attribute(rule["when_field"]) == rule["when_value"] if rule.get("when_field") else F.lit(True)
        return applies & blank(attribute(rule["required_field"]))
    if kind == "regex_format":
        return ~attribute(rule["field"]).rlike(rule["pattern"])
    if kind == "value_range":
        v = attribute(rule["field"]).try_cast("double")
        tests = [v < rule["min"]] if rule.get("min") is not None else []
        tests += [v > rule["max"]] if rule.get("max") is not None else []
        if rule.get("relative_to"):
            tests.append(v < attribute(rule["relative_to"]).try_cast("double") * (1 + rule.get("must_exceed_by_pct", 0) / 100))
        return reduce(lambda x, y: x | y, tests) if tests else F.lit(False)
    return ~compile_expression(rule["expression"])


def evaluate(tags: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule, id, severity): tags that break an active rule of single tags, in the document types it applies to."""
    broken = []
    for r in rules:
        if r.get("check_type") == "field_equality" or not r.get("active", True) or validate(r):
            continue
        scope = F.col("doc_type").isin(r["doc_types"]) if r.get("doc_types") else F.lit(True)
        if r.get("tag_type"):
            scope = scope & (F.col("tag_type") == r["tag_type"])
        hit = scope & F.coalesce(failing(r), F.lit(False))
        broken.append(F.when(hit, F.struct(F.lit(r["name"]).alias("rule"), F.lit(r.get("severity", "warning")).alias("severity"))))
    if not broken:
        return tags.select(F.lit("").alias("rule"), "id", F.lit("").alias("severity")).limit(0)
    # All rules in one pass over the tags.
    return tags.select("id", F.inline(F.array_compact(F.array(*broken)))).select("rule", "id", "severity")
