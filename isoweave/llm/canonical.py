"""Free-entered values mapped to a canonical list (problem 6).

Values are normalised and deduplicated over all sources; candidates come from an
inverted index of character 2- and 3-grams over the list's names and a table of
synonyms; the score is the cosine of tf-idf weighted grams. Only a value's rarest grams are
looked up: those left out cannot lift a phrase that shares nothing else to the least score,
so no phrase is lost and common grams bring no candidates. A value is accepted above a
threshold and with a margin over the best other term, after a check by edit distance for
short or misspelt values. All steps are joins and aggregates of distinct values.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import guarded_broadcast, materialise

#: Cosine from which a value is accepted alone, and with the edit distance in its favour; margin over another term.
ACCEPT, ACCEPT_NEAR, MARGIN = 0.62, 0.12, 0.04
#: A stated kind wins over "kind not stated" from this cosine, if it is not further behind than that.
KIND, KIND_BEHIND = 0.45, 0.25

# Usual short forms and synonyms by term.
SHORT_FORMS: dict[str, str] = {
    "Pipe": "pipe|piping|line pipe|tube|pipe seamless|pipe smls",
    "Elbow": "elbow|ell|elbo|elbows|bend|elbow lr|elbow sr|elbow 90|90 deg elbow|45 deg elbow|bw elbow|fitting elbow",
    "Tee": "tee|tees|t piece|equal tee|reducing tee|red tee|tee reduced|tee eq|fitting tee",
    "Reducer": "reducer|reducers|redu|red|conc reducer|ecc reducer|reducer eccentric|reducer concentric|red conc|red ecc|swage",
    "Cap": "cap|caps|pipe cap|end cap|cap bw",
    "Branch outlet": "branch outlet|olet|olets|o let|weldolet|weld o let|sockolet|sock o let|threadolet",
    "Coupling": "coupling|couplings|coup|cplg|full cplg|half coupling|full coupling",
    "Nipple": "nipple|nipples|nip|pipe nipple",
    "Union": "union|unions|unio|union sw|ground joint union",
    "Flange": "flange|flanges|flan|flng|flg|weld neck flange|flange wn|wnrf flange|flange slip on|slip on flange|lap joint flange",
    "Blind flange": "blind flange|flange blind|blind flg|bld flg|blank flange|fbli",
    "Spectacle blind": "spectacle blind|spectacle blinds|spec blind|spec bld|figure 8|fig 8 blind|figure eight|spade|spacer",
    "Gasket": "gasket|gaskets|gask|gskt|spw gasket|gasket spiral wound",
    "Stud bolt": "stud bolt|stud bolts|bolt|bolts|stud|studs|bolting|bolt set|nuts",
    "Strainer": "strainer|strainers|strnr|y strainer|y type strainer|basket strainer|filter",
    "Expansion joint": "expansion joint|exp joint|exp jt|expn joint|bellows|joint expansion",
    "Support": "support|supports|supp|pipe support|shoe|pipe shoe|spring hanger|hanger|clamp|u bolt clamp|u bolt|guide|anchor",
    "Instrument": "instrument|instruments|inst|instr|in line instrument",
    "Fitting, kind not stated": "fitting|fittings|ftg|ftgs|fttgs|pipe fitting|pipe fittings",
    "Valve, kind not stated": "valve|valves|vlv|vlvs|valv",
    "Gate valve": "gate|gate valve|gate valves|gate vlv|gtv|sluice valve|wedge gate valve",
    "Ball valve": "ball|ball valve|ball valves|ball vlv|blv|ball valve fb",
    "Globe valve": "globe|globe valve|globe valves|globe vlv|glv",
    "Check valve": "check|check valve|check valves|check vlv|chk vlv|chk|non return|non return valve|nrv|swing check",
    "Butterfly valve": "butterfly|butterfly valve|butterfly vlv|bfly vlv|bfly valve|bfv",
    "Plug valve": "plug|plug valve|plug valves|plug vlv|plv",
    "Needle valve": "needle|needle valve|needle vlv|ndl vlv",
    "Diaphragm valve": "diaphragm|diaphragm valve|diaph vlv|membrane valve",
    "Control valve": "control|control valve|ctrl vlv|cont valve|fcv|lcv|pcv|tcv",
    "Relief or safety valve": "relief|relief valve|safety valve|safety relief|relief safety|press relief valve|psv|prv|tsv|pressure relief valve",
}
# End of fixed values.


def normalise(v: Column) -> Column:
    """Lower case, apostrophes dropped, every other run of signs to one blank."""
    t = F.regexp_replace(F.lower(v), "['’`]", "")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def is_blank(v: Column) -> Column:
    t = F.upper(F.regexp_replace(v, r"^[\s ]+|[\s ]+$", ""))
    return v.isNull() | t.isin("", "-", "N/A")


def grams(nv: Column) -> Column:
    """All 2- and 3-grams of each token with marked ends, order of tokens without weight."""

    def of(t: Column) -> Column:
        m = F.concat(F.lit("^"), t, F.lit("$"))
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(m) - n + 1, F.lit(1))), lambda i: F.substr(m, i, F.lit(n)))
        return F.concat(cut(2), cut(3))

    return F.flatten(F.transform(F.filter(F.split(nv, " "), lambda t: t != ""), of))


def usual_forms(terms: DataFrame) -> DataFrame:
    """(term, phrase): the short forms and synonyms above as a table, the default of `assign`."""
    rows = [(t, p) for t, forms in SHORT_FORMS.items() for p in forms.split("|")]
    return terms.sparkSession.createDataFrame(rows, "term string, phrase string")


def entries(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(term_id, generic, phrase): every name of the list, up to its first comma, and every synonym."""
    named = terms.select("term_id", "term", F.lower("term").contains("kind not stated").alias("generic"))
    own = named.select("term_id", "generic", F.split("term", ",")[0].alias("p"))
    other = named.join(synonyms.select("term", F.col("phrase").alias("p")), "term").select("term_id", "generic", "p")
    return own.unionByName(other).select("term_id", "generic", normalise(F.col("p")).alias("phrase")).filter("phrase <> ''").distinct()


def assign(values: DataFrame, terms: DataFrame, value: str = "value", synonyms: DataFrame | None = None) -> DataFrame:
    """(nv, term_id, score, runner_up) for every distinct normalised value; term_id 0 where none is close enough.

    The list's phrases are the index. synonyms: (term, phrase), further names of the list's terms; by default those of
    `usual_forms`. Defined cases: null and blank values do not take part; ties between two terms are no match; a value
    without letters or digits maps to 0; an empty list maps all to 0; without synonyms the names alone count.
    """
    distinct = materialise(values.select(normalise(F.col(value)).alias("nv")).filter("nv is not null").distinct(), "values")
    index = materialise(entries(terms, usual_forms(terms) if synonyms is None else synonyms), "entries")
    total = float(index.count() + 1)
    count = lambda df, of: df.select("*", F.explode(grams(F.col(of))).alias("g")).groupBy(*df.columns, "g").agg(F.count("*").alias("tf"))
    posting = count(index, "phrase")
    idf = guarded_broadcast(materialise(posting.groupBy("g").agg(F.log(F.lit(total) / F.countDistinct("phrase")).alias("idf")), "idf"))
    # A vector is a map from gram to weight; phrases have length 1.
    vector = lambda df: F.map_from_entries(F.collect_list(F.struct("g", "w")))
    weighted = posting.join(idf, "g").withColumn("w", F.sqrt("tf") * F.col("idf"))
    phrases = weighted.groupBy("term_id", "generic", "phrase").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), vector(weighted).alias("pv"))
    phrases = materialise(phrases.select("term_id", "generic", "phrase", F.transform_values("pv", lambda _, w: w / F.col("norm")).alias("pv")), "phrases")
    postings = guarded_broadcast(phrases.select(F.explode(F.map_keys("pv")).alias("g"), "term_id", "phrase"))
    vw = count(distinct, "nv").join(idf, "g", "left").withColumn("w", F.sqrt("tf") * F.coalesce("idf", F.lit(math.log(total))))
    vectors = materialise(vw.groupBy("nv").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("vnorm"), vector(vw).alias("vv")), "vectors")
    # Grams from the lightest on whose weights together stay below the least score are not looked up.
    light = F.array_sort(F.transform(F.map_entries("vv"), lambda e: F.struct(e["value"].alias("w"), e["key"].alias("g"))))
    spare = F.pow(F.col("vnorm") * ACCEPT_NEAR, 2)
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<string>").alias("gs"))
    step = lambda acc, e: F.struct((acc["sum"] + e["w"] * e["w"]).alias("sum"), F.when(acc["sum"] + e["w"] * e["w"] < spare, acc["gs"]).otherwise(F.concat(acc["gs"], F.array(e["g"]))).alias("gs"))
    asked = vectors.select("nv", F.explode(F.aggregate(light, start, step, lambda acc: acc["gs"])).alias("g"))
    candidates = asked.join(postings, "g").select("nv", "term_id", "phrase").distinct()
    hits = candidates.join(vectors, "nv").join(guarded_broadcast(phrases), ["term_id", "phrase"])
    dot = F.aggregate(F.map_entries("vv"), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(F.col("pv"), e["key"]), F.lit(0.0)))
    packed = lambda c: F.array_join(F.array_sort(F.split(c, " ")), "")
    letters = lambda c: F.array_join(F.array_sort(F.split(packed(c), "")), "")
    length = F.length(packed(F.col("nv")))
    scored = hits.select("nv", "term_id", "generic", "phrase", (dot / F.col("vnorm")).alias("cos"))
    edits = F.least(F.levenshtein(packed(F.col("nv")), packed(F.col("phrase"))), F.levenshtein("nv", "phrase"))
    # Two letters swapped are one slip.
    scored = scored.withColumn("edits", F.when((edits == 2) & (letters(F.col("nv")) == letters(F.col("phrase"))), 1).otherwise(edits))
    scored = scored.withColumn("near", (F.col("edits") == 0) | ((F.col("edits") == 1) & (length >= 3)) | ((F.col("edits") == 2) & (length >= 8)))
    # Of two phrases as near, the one that is itself written somewhere is the likelier.
    written = guarded_broadcast(distinct.join(guarded_broadcast(index.select(F.col("phrase").alias("nv")).distinct()), "nv").select(F.col("nv").alias("phrase"), F.lit(0.2).alias("seen")))
    scored = scored.join(written, "phrase", "left").withColumn("bonus", F.when(F.col("edits") == 0, 1.0).otherwise(0.5 / F.col("edits") + F.coalesce("seen", F.lit(0.0))))
    by_term = scored.groupBy("nv", "term_id", "generic").agg(
        F.max(F.struct((F.col("cos") + F.when(F.col("near"), F.col("bonus")).otherwise(0.0)).alias("rank"), "cos", "near")).alias("b")
    )
    flat = by_term.select("nv", "term_id", "generic", "b.*")
    top = Window.partitionBy("nv", "generic").orderBy(F.desc("rank"), "term_id")
    ranked = flat.withColumn("r", F.row_number().over(top)).withColumn("next", F.lead("rank").over(top)).filter("r = 1")
    sides = ranked.groupBy("nv").agg(
        *[F.max(F.when(F.col("generic") == g, F.struct("rank", "cos", "near", "term_id", "next"))).alias(n) for g, n in ((True, "bare"), (False, "kind"))]
    )
    enough = lambda s: ((F.col(f"{s}.cos") >= ACCEPT) | (F.col(f"{s}.near") & (F.col(f"{s}.cos") >= ACCEPT_NEAR))) & (F.col(f"{s}.rank") - F.coalesce(F.col(f"{s}.next"), F.lit(0.0)) >= MARGIN)
    kind_ok = F.coalesce(enough("kind"), F.lit(False))
    bare_ok = F.coalesce(enough("bare"), F.lit(False))
    kind_first = F.col("bare").isNull() | ~bare_ok | ((F.col("kind.cos") >= KIND) & (F.col("kind.rank") >= F.col("bare.rank") - KIND_BEHIND))
    chosen = F.when(kind_ok & kind_first, F.col("kind.term_id")).when(bare_ok, F.col("bare.term_id")).otherwise(F.lit(0))
    best = sides.select("nv", chosen.cast("int").alias("term_id"), F.greatest("kind.cos", "bare.cos").alias("score"), F.col("kind.next").alias("runner_up"))
    return distinct.join(best, "nv", "left").select("nv", F.coalesce("term_id", F.lit(0)).alias("term_id"), F.coalesce("score", F.lit(0.0)).alias("score"), "runner_up")


SOURCES = (("sheet_items.type", "sheet_items", "type"), ("bom_rows.component_type", "bom_rows", "component_type"), ("valve_matches.category", "valve_matches", "category"))


def domain_values(tables: dict[str, DataFrame]) -> DataFrame:
    """(source_field, row_id, value) of the three free-entered columns, blanks left out."""
    parts = [tables[t].select(F.lit(f).alias("source_field"), F.col("id").cast("bigint").alias("row_id"), F.col(c).alias("value")) for f, t, c in SOURCES]
    return reduce(DataFrame.unionByName, parts).filter(~is_blank(F.col("value")))


def map_values(values: DataFrame, terms: DataFrame) -> DataFrame:
    """``values`` with the term of each row; the mapping is joined by value, so a value held by a third of all rows is split by AQE or never shuffled."""
    mapping = materialise(assign(values, terms), "mapping")
    return values.withColumn("nv", normalise(F.col("value"))).join(guarded_broadcast(mapping), "nv").drop("nv")
