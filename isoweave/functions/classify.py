"""Classifiers: ordered rules over texts, the first that fits decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered patterns; None as label means out of scope.
VALVES = [
    ("check", r"check|non.?return|\bnrv\b"),
    ("relief/safety", r"relief|safety|\bpsv\b|\bprv\b|\btsv\b|rupture"),
    ("control", r"control valve|\bcv\b-|\bfv-|\bpcv|\btcv|\blcv|\bfcv\b|\bxv-|actuated|emergency isolation|\beiv\b"),
    ("gate", r"\bgate\b"),
    ("ball", r"\bball\b"),
    ("globe", r"\bglobe\b"),
    ("butterfly", r"butterfly"),
    ("plug", r"\bplug\b"),
    ("needle", r"needle"),
    ("diaphragm", r"diaphragm"),
    ("other valves", r"valve"),
]
FASTENERS = r"gasket|\bbolt\b|\bstud\b|\bnut\b|washer"
EXPANSION = r"expansion\s*joint|bellows|\bej\b"
ACCESSORIES = r"positioner|actuator|limit\s*switch|solenoid|handswitch|\bhs-|manifold"
PIPE_PARTS = r"elbow|tee|reducer|flange|olet|coupling|\bcap\b|bend|nipple"
FITTINGS = [
    ("elbows", r"\belbo|\bbend\b|\bell\b"),
    ("tees", r"\btee\b|\btees\b"),
    ("reducers", r"\bredu|swage|\bred\s*conc|\bred\s*ecc"),
    ("spectacle blinds", r"spectacle|figure.?8|\bfig\.?\s*8\b|\bspade\b"),
    ("flanges", r"flange|\bflg\b|\bflan\b"),
    ("olets", r"olet|stub.?in|stub.?on"),
    ("caps", r"\bcap\b|\bplug\b"),
    ("couplings", r"coupling|\bcplg\b|union|\bnipp"),
]
BOM_EXCLUDED = r"\bcontrol\s*valve\b|\binstrument\b|\bgasket\b|\bstud\s*bolt\b|\bbolt\s*set\b|\bpipe\s*support\b|\bsupport\b|\breinforcement\b|\bexpansion\s*joint\b|\bstrainer\b"
BOM = [
    ("fittings", "reduced", r"\breducing\s*tee\b|\btee\s*\(?\s*red"),
    ("fittings", "straight", r"\bequal\s*tee\b"),
    ("fittings", "tee", r"\btee\b"),
    ("fittings", "olet", r"\bweldolet\b|\bo'?let\b|\bsockolet\b"),
    ("fittings", "reducer", r"\breducer\b|\bredu\b"),
    ("fittings", "elbow", r"\belbow\b"),
    ("fittings", "cap", r"\bcap\b"),
    ("flanges", "spectacle", r"\bspectacle\b"),
    ("flanges", "spade", r"\bspade\b|\bspacer\b"),
    ("flanges", "orifice", r"\borifice\b"),
    ("flanges", "blind", r"\bblind\s*flange\b|\bflange,?\s*blind\b"),
    ("flanges", "flange", r"\bflange\b"),
    ("valves", "ball", r"\bball\s*valve\b"),
    ("valves", "gate", r"\bgate\s*valve\b"),
    ("valves", "globe", r"\bglobe\s*valve\b"),
    ("valves", "check", r"\bcheck\s*valve\b"),
    ("valves", "butterfly", r"\bbutterfly\s*valve\b"),
    ("valves", "", r"\bvalve\b"),
    ("pipes", "", r"\bpipe\b"),
]
ENDS = [
    ("gasket", r"\bgaskets?\b|\bflanges?\b"),
    ("fitting", r"\belbows?\b|\btees?\b|\bweldolets?\b|\breducers?\b"),
    ("tie-in", r"\btie-?in\b|\bcont\.?\s*(?:on|from)\b"),
]
VALVE_ITEMS = ("7", "13", "14", "19")
# End of fixed values.


def ladder(text: Column, rules: list[tuple[str, str]]) -> Column:
    head, *rest = rules
    return reduce(lambda w, r: w.when(text.rlike(r[1]), r[0]), rest, F.when(text.rlike(head[1]), head[0]))


def lower(v: Column) -> Column:
    return F.lower(F.coalesce(v, F.lit("")))


def valve(v: Column) -> Column:
    return ladder(lower(v), VALVES)


def fitting(component: Column, description: Column) -> Column:
    """Category of a bill row; null for fasteners, supports, instruments and plain pipe."""
    c = lower(component)
    t = F.concat(c, F.lit(" "), lower(description))
    excluded = t.rlike(FASTENERS) | c.contains("support") | t.rlike(r"\bsupport\b")
    head = (
        F.when(excluded, None).when(t.rlike(EXPANSION), "expansion joints").when(t.contains("valve") & ~t.rlike(ACCESSORIES), "valves")
        .when(c.contains("instrument") | (t.rlike(r"\bpipe\b") & ~t.rlike(PIPE_PARTS)), None)
    )
    return reduce(lambda w, r: w.when(t.rlike(r[1]), r[0]), FITTINGS, head).when(c.contains("fitting"), "other fittings")


def spec_array(component: Column) -> Column:
    """Array of a class that holds rows for a component."""
    c = lower(component)
    return F.when(c.contains("pipe") & ~c.contains("support"), "pipes").when(c.contains("fitting"), "fittings").when(c.contains("flange"), "flanges").when(c.contains("valve"), "valves")


def bom(component: Column, description: Column) -> Column:
    """struct<category, hint> of a bill row, null if out of scope; the hint is '' for any valve and for pipe."""
    t = F.concat(lower(component), F.lit(" "), lower(description))
    out = F.when(t.rlike(BOM_EXCLUDED), None)
    for category, hint, pattern in BOM:
        out = out.when(t.rlike(pattern), F.struct(F.lit(category).alias("category"), F.lit(hint).alias("hint")))
    return out


def dimension_end(ref: Column, valve_items: tuple[str, ...] = VALVE_ITEMS) -> Column:
    """weld, valve, gasket, fitting or tie-in that a dimension's end refers to."""
    t = F.lower(ref)
    item = F.regexp_extract(t, r"\bitem\s*(\d+)\b", 1)
    head = F.when(t.rlike(r"\b(?:bw|sw|fw)\s*0*\d+\b"), "weld").when(t.rlike(r"\bvalves?\b") | item.isin(*valve_items), "valve")
    return reduce(lambda w, r: w.when(t.rlike(r[1]), r[0]), ENDS, head)


def without_cross_end(one: Column, other: Column) -> Column:
    """A valve at one end with a weld at the other is no valve of the dimension."""
    return F.when((one == "valve") & F.coalesce(other == "weld", F.lit(False)), None).otherwise(one)


def weld_place(tag: Column) -> Column:
    """shop or field by a weld tag's prefix."""
    t = F.upper(tag)
    return F.when(t.rlike(r"^(?:SW|BW)"), "shop").when(t.rlike(r"^FW"), "field")


def implies_field(kind: Column) -> Column:
    """Whether a weld list type means a field weld; null for no type."""
    return F.when(F.trim(kind) != "", F.lower(kind).contains("field"))
