"""Nested records to related flat tables (problem 1).

A column of JSON text is parsed once into a VARIANT. A merged schema is
inferred level by level with ``schema_of_variant_agg`` over all rows; every
repeated field found becomes a child level whose rows carry the parent's key
and the ordinals of all enclosing elements. Levels are exploded by the JVM's
generators: there is no Python and no shuffle but the small schema aggregate.

Forms of a repeated field that are understood: an array, a lone object
(position 0), either of them as JSON text within a string, null or absent (no
elements). Elements that are not objects keep their position; elements that are
arrays are a level of their own, as are objects keyed by data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

#: Steps of a path that are no names: the elements of an element that is an array; the entries of an object keyed by data.
LIST, ENTRIES = "[]", "{}"
_END = "-- end of text --"


def parse(col: Column) -> Column:
    """VARIANT of a JSON text; null where the text cannot be read (also: text after the first value).

    The reader stops after the first value, so the text is read as the first of two elements: if anything but white
    space follows the value, the second is not where it should be.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), col, F.lit(f',"{_END}"]')))
    return F.when(F.try_variant_get(pair, "$[1]", "string") == _END, F.try_variant_get(pair, "$[0]", "variant"))


# --- paths -----------------------------------------------------------------------------------------


def joined(names: list[str]) -> str:
    """Path text of steps: dots between them, a name with a sign of the path language in backquotes."""
    plain = lambda n: n in (LIST, ENTRIES) or not re.search(r"[./`\[\]{}]|^$", n)
    return ".".join(n if plain(n) else "`" + n.replace("`", "``") + "`" for n in names)


def steps(path: str) -> list[str]:
    """Steps of a path text."""
    return [m[1].replace("``", "`") if m[1] is not None else m[2] for m in re.finditer(r"`((?:[^`]|``)*)`|([^.`]+)", path)]


def _segment(name: str) -> str | None:
    """A step in the language of variant paths, null for names that it cannot say."""
    if re.fullmatch(r"\w+", name, re.ASCII):
        return f".{name}"
    return f"['{name}']" if re.fullmatch(r"[^\s'?\\][^'?\\]*", name) else None


def get(v: Column, path: str | list[str], kind: str = "variant") -> Column:
    """Value under a path, whatever signs its names have; null where there is none or it is not of the kind."""
    at_ = "$"
    for name in steps(path) if isinstance(path, str) else path:
        seg = _segment(name)
        if seg:
            at_ += seg
            continue
        here = F.try_variant_get(v, at_, "map<string,variant>")
        v, at_ = F.try_element_at(here, F.lit(name)), "$"
    return F.try_variant_get(v, at_, kind)


def at(v: Column, path: str) -> Column:
    """The VARIANT under a path; objects on the way may be stored as JSON text."""
    names = [n for n in steps(path) if n not in (LIST, ENTRIES)]
    if not names:
        return v
    out = get(v, names)
    if len(names) > 1:
        head = get(v, names[:1])
        text = F.try_variant_get(head, "$", "string")
        out = F.coalesce(out, F.when(F.schema_of_variant(head) == "STRING", at(F.try_parse_json(text), joined(names[1:]))))
    return out


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def elements(v: Column, lone_too: bool = True) -> Column:
    """array<variant> of a repeated field in whatever form it is stored; null if it has none."""
    as_array = lambda x: F.try_variant_get(x, "$", "array<variant>")
    text = F.try_variant_get(v, "$", "string")
    inner = F.try_parse_json(text)
    lone = lambda x: F.when(is_object(x), F.array(x))
    # try_parse_json of an object's own text gives the same object, so one fallback serves both forms
    return F.coalesce(as_array(v), F.when(text.rlike(r"^\s*[\[{]"), F.coalesce(as_array(inner), lone(inner)) if lone_too else as_array(inner)))


def entries(v: Column) -> Column:
    """array<variant> of {key, value} objects, one per field in the order of keys; null if it is no object."""
    pairs = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.transform(pairs, lambda e: F.to_variant_object(F.struct(e["key"].alias("key"), e["value"].alias("value"))))


# --- merged schema -------------------------------------------------------------------------------


@dataclass
class Node:
    """One level of the merged schema: scalar leaves and repeated children by path."""

    path: str
    leaves: dict[str, str] = field(default_factory=dict)
    repeated: dict[str, "Node"] = field(default_factory=dict)
    wide: list[str] = field(default_factory=list)
    mixed: list[str] = field(default_factory=list)  # stored in more than one form
    ways: set[str] = field(default_factory=set)  # arrays that lead to an asked-for name; of mixed ones only the array forms


def _read_type(s: str, i: int = 0) -> tuple[object, int]:
    """Parse the text that schema_of_variant_agg returns: OBJECT<k: T, ...>, ARRAY<T> or a scalar name."""
    if s.startswith("OBJECT<", i):
        fields, i = {}, i + 7
        while s[i] != ">":
            if s[i] == "`":
                j = i + 1
                while s[j] != "`" or s[j + 1 : j + 2] == "`":
                    j += 2 if s[j] == "`" else 1
                name, i = s[i + 1 : j].replace("``", "`"), j + 1
            else:
                j = s.index(":", i)
                name, i = s[i:j], j
            i = re.compile(r":\s*").match(s, i).end()
            fields[name], i = _read_type(s, i)
            i = re.compile(r"(,\s*)?").match(s, i).end()
        return fields, i + 1
    if s.startswith("ARRAY<", i):
        inner, i = _read_type(s, i + 6)
        return [inner], i + 1
    m = re.compile(r"\w+(\([^)]*\))?").match(s, i)
    return m.group(), m.end()


def _leads(kind: object, only: set[str]) -> bool:
    """Whether a field of this type leads to a name in ``only``, or may, as its form is mixed."""
    if isinstance(kind, dict):
        return any(k in only or _leads(v, only) for k, v in kind.items())
    return _leads(kind[0], only) if isinstance(kind, list) else kind == "VARIANT"


def _walk(node: Node, kind: object, names: list[str], max_fields: int, only: set[str] | None = None) -> None:
    path = joined(names)
    if names and only and names[-1] in only:  # asked for: repeated in whatever form it is stored
        node.repeated[path] = Node(path)
    elif isinstance(kind, dict):
        if len(kind) > max_fields:
            node.wide.append(path or "$")
            if only is None:
                deep = joined([*names, ENTRIES])
                node.repeated[deep] = Node(deep)
            # Scalars stay columns; what is asked for by name, or leads there, is never left out.
            kind = {k: v for k, v in kind.items() if (isinstance(v, str) and (only or v != "VARIANT")) or (only and (k in only or _leads(v, only)))}
        for name, sub in kind.items():
            _walk(node, sub, [*names, name], max_fields, only)
    elif names and (isinstance(kind, list) or kind == "VARIANT"):
        node.repeated[path] = Node(path)
        if kind == "VARIANT":
            node.mixed.append(path)
            node.leaves[path] = "VARIANT"  # rows that hold scalars
        elif only and _leads(kind, only):
            node.ways.add(path)
    elif names:
        node.leaves[path] = str(kind)


def _known(s: str | None) -> object:
    return _read_type(s)[0] if s and s != "VOID" else None


def infer(levels: DataFrame, path_col: str, value_col: str, max_fields: int, only: set[str] | None = None) -> dict[str, Node]:
    """Merged schema of every level named in ``path_col`` over all its rows; one aggregate, one row a level."""
    # The form is read once, and the conditions stand inside the aggregate: a filter below it would parse every text a second time.
    formed = levels.select(F.col(path_col).alias("level"), F.col(value_col).alias("v"), F.substring(F.schema_of_variant(F.col(value_col)), 1, 5).alias("form"))
    merged = lambda form: F.expr(f"schema_of_variant_agg(v) filter (where form = '{form}')")
    rows = formed.groupBy("level").agg(merged("OBJEC").alias("s"), merged("ARRAY").alias("lists"))
    out = {}
    for r in rows.toLocalIterator():  # one row per level of the schema, not per record
        node = Node(r[0])
        kind, lists = _known(r["s"]), _known(r["lists"])
        if kind is not None:
            _walk(node, kind, [], max_fields, only)
        if lists is not None:
            node.repeated[LIST] = Node(LIST)
            if only and _leads(lists, only):
                node.ways.add(LIST)
        out[r[0]] = node
    return out


def resolve_mixed(level: DataFrame, schema: dict[str, Node], max_fields: int, only: set[str] | None = None) -> None:
    """Fields stored in several forms that are objects or text of objects, never arrays, are objects: add their fields.

    On the way to names in ``only`` each form is followed where it stands: the fields of objects as fields, arrays as a level.
    """
    pairs = [(name, p) for name, node in schema.items() for p in node.mixed]
    if not pairs:
        return
    v = F.col("v")
    forms = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("path"), F.when(F.col("level") == name, get(v, p)).alias("x")) for name, p in pairs])
    one = level.filter(is_object(v)).select(F.inline(F.filter(forms, lambda f: f["x"].isNotNull())))
    inner = F.try_parse_json(F.try_variant_get("x", "$", "string"))  # of an object's own text: the object
    kinds = one.select("name", "path", F.schema_of_variant("x").startswith("ARRAY").alias("listed"), inner.alias("o"))
    rows = kinds.groupBy("name", "path").agg(F.max(F.col("listed") | F.coalesce(F.schema_of_variant("o").startswith("ARRAY"), F.lit(False))).alias("listed"), F.expr("schema_of_variant_agg(o) filter (where schema_of_variant(o) like 'OBJECT%')").alias("s"), F.expr("schema_of_variant_agg(o) filter (where schema_of_variant(o) like 'ARRAY%')").alias("arrays"))
    for r in rows.toLocalIterator():  # one row per field of the schema
        kind, arrays = _known(r["s"]), _known(r["arrays"])
        node = schema[r["name"]]
        if isinstance(kind, dict) and (only or not r["listed"]):
            if not r["listed"]:
                del node.repeated[r["path"]]
            _walk(node, kind, steps(r["path"]), max_fields, only)
        if only and r["listed"] and arrays is not None and _leads(arrays, only):
            node.ways.add(r["path"])


# --- exploding -----------------------------------------------------------------------------------


def explode_level(df: DataFrame, children: dict[str, list[str]], keep: list[str], arrays: set[tuple[str, str]] = frozenset()) -> DataFrame:
    """Explode repeated fields of the elements in ``df(level, ords, v)``; of (level, path) in ``arrays`` no lone objects.

    ``children`` maps a level to the paths to explode there. All children come from one pass;
    the result has the same columns, one row per stored element with ``ords`` one longer.
    """
    known = [c for paths in children.values() for c in paths]
    if not known:
        return df.limit(0)

    def items(level: str, path: str) -> Column:
        last = steps(path)[-1]
        v = at(F.col("v"), path)
        return entries(v) if last == ENTRIES else elements(v, last != LIST and (level, path) not in arrays)

    branches = F.array(
        *[
            F.struct(F.lit(f"{level}/{p}").alias("level"), F.when(F.col("level") == level, items(level, p)).alias("items"))
            for level, paths in children.items()
            for p in paths
        ]
    )
    stacked = df.select(*keep, "ords", F.inline(F.filter(branches, lambda b: F.size(b["items"]) > 0)))
    return stacked.select(*keep, "ords", "level", F.posexplode("items").alias("pos", "v")).select(
        *keep, F.concat("ords", F.array("pos")).alias("ords"), "level", "v"
    )


@dataclass
class Shredded:
    """``rows``: (key columns, row_key, level, ords array<int>, v variant), one per stored element of every level."""

    rows: DataFrame
    schema: dict[str, Node]
    keys: list[str]
    whole: bool = False

    def flat(self, level: str, *also: str) -> DataFrame:
        """Typed flat table of one level, and of others that hold the same in another form.

        Columns: keys, ``row_key`` of the record, ``parent_key`` and ``element_key``, ``parent_ords``, ``pos``, one column
        per leaf of the merged schema. ``element_key`` is unique within the level, and ``parent_key`` is the
        ``element_key`` of the row's parent in its level, repeated and null natural keys notwithstanding.

        Leaf columns are named after their path, with ``__`` for a dot and a ``_2``, ``_3`` ... suffix where
        that clashes with a key. A field stored in several forms is text; rows that hold arrays or objects have null there
        if the levels below have them (``whole`` not set), else their JSON text. Elements that are not objects give a row with null leaves and their text in
        ``scalar_text``.
        """
        used, leaves = {*self.keys, "row_key", "parent_key", "element_key", "parent_ords", "pos", "scalar_text"}, {}
        for node in [self.schema.get(x, Node(x)) for x in (level, *also)]:
            for path, kind in node.leaves.items():
                leaves[path] = kind if leaves.get(path, "VOID") in ("VOID", kind) else leaves[path] if kind == "VOID" else "VARIANT"
        cols = []
        for path, kind in leaves.items():
            names = [s for s in steps(path) if s != ENTRIES]
            base, n = "__".join(names).replace("`", "_"), 2
            name = base
            while name.lower() in {u.lower() for u in used}:
                name, n = f"{base}_{n}", n + 1
            used.add(name)
            value = get(F.col("v"), names, "string" if kind in ("VOID", "VARIANT") else kind)
            if kind == "VARIANT" and not self.whole:
                value = F.when(elements(at(F.col("v"), path)).isNull(), value)
            cols.append(value.alias(name))
        up = F.slice("ords", F.lit(1), F.greatest(F.size("ords") - 1, F.lit(0)))
        spot = lambda o: F.concat_ws("/", "row_key", o.cast("array<string>"))
        return self.rows.filter(F.col("level").isin(level, *also)).select(
            *self.keys,
            "row_key",
            spot(up).alias("parent_key"),
            spot(F.col("ords")).alias("element_key"),
            up.alias("parent_ords"),
            F.try_element_at("ords", F.lit(-1)).alias("pos"),
            *cols,
            F.when(~is_object(F.col("v")), F.try_variant_get("v", "$", "string")).alias("scalar_text"),
        )


def numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``row_key``, one key per stored row: its file and its number there, the same in every reading.

    A frame that comes from no file is written to the shared folder first.
    """
    has = df._jdf.queryExecution().analyzed().metadataOutput().mkString(" ")
    place = F.concat_ws("-", F.lower(F.hex(F.xxhash64("_metadata.file_path"))), F.col("_metadata.row_index").cast("string"))
    if "_metadata" in has:
        try:
            return df.select(*columns, place.alias("row_key"))
        except AnalysisException:  # files of a format that does not number its rows
            pass
    return materialise(df.select(*columns), "records").select(*columns, place.alias("row_key"))


def shred(
    df: DataFrame,
    json_col: str,
    keys: list[str],
    root: str = "$",
    only: set[str] | None = None,
    max_depth: int | None = None,
    max_fields: int = 400,
) -> Shredded:
    """Flatten ``json_col`` into one long table of elements, carrying ``keys``, a key of each record and all ordinals.

    root: where to begin, "$" or a top-level field that is itself repeated. only: names of repeated fields to
    follow (their last path step) beside those on the way, in objects and arrays; the rows are then those of the
    levels asked for. None follows all that the merged schema has, arrays of arrays included (level ``.../[]``).
    max_depth: levels below the root that may be found before an error is raised; None goes down to the last.
    max_fields: an object with more fields than this is keyed by data, not by name: it is reported in ``schema[level].wide``
    and becomes a level ``.../{}`` of {key, value} elements in the order of keys, whose values are followed further; its
    scalars are columns of its own level too. With ``only`` it is followed for the names asked for.

    Defined cases: null, empty and unreadable text has no rows; white space around the value is no matter; names may
    hold any signs; a null key keeps its rows; an empty table gives an empty result; repeated rows are kept, each with
    its own key and elements; other columns are ignored, whatever their names.
    """
    plain = df.select(*[F.col(k).alias(k) for k in keys if k != json_col], F.col(json_col).alias("_json"), *([F.col(json_col)] if json_col in keys else []))
    src = numbered(plain, [*keys, "_json"]).select(*keys, "row_key", parse(F.col("_json")).alias("v"))
    carried = [*keys, "row_key"]
    base = src.select(*carried, F.array().cast("array<int>").alias("ords"), F.lit("$").alias("level"), "v")
    if root != "$":
        level = base.select(*carried, F.posexplode(elements(at(F.col("v"), root))).alias("pos", "v"))
        level = level.select(*carried, F.array("pos").alias("ords"), F.lit(root).alias("level"), "v")
    else:
        level = base
    schema: dict[str, Node] = {}
    out, found = None, False
    depth = 0
    while True:
        here = infer(level, "level", "v", max_fields, only)
        if only is None or only:
            resolve_mixed(level, here, max_fields, only)
        schema |= here
        asked = {name: [p for p in node.repeated if only is None or steps(p)[-1] in only] for name, node in here.items()}
        ways = {name: [p for p in node.repeated if p in node.ways and p not in asked[name]] for name, node in here.items()}
        follow = {name: asked[name] + ways[name] for name in here if asked[name] + ways[name]}
        if out is None or only is None:
            out = level.filter(F.col("v").isNotNull()) if out is None else out.unionByName(level)
        if not follow:
            break
        if depth == max_depth:
            raise ValueError(f"shred: levels below max_depth={max_depth}: {sorted(follow)}")
        depth += 1
        level = explode_level(level, follow, carried, {(name, p) for name, ps in ways.items() for p in ps})
        if only is not None:
            # The levels asked for are leaves of the walk; their parents were only the way.
            wanted = [f"{name}/{p}" for name, ps in asked.items() for p in ps]
            onward = [f"{name}/{p}" for name, ps in ways.items() for p in ps]
            if wanted:
                leaf = level.filter(F.col("level").isin(wanted)) if onward else level
                out = leaf if not found else out.unionByName(leaf)
                found = True
            if not onward:
                break
            level = level.filter(F.col("level").isin(onward))
    return Shredded(out, schema, keys)
