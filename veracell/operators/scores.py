"""Scores and explanations of cells that hold their evidence as one array.

``obs`` is an array of (scope, source, family, polarity, strength, hard, detail). All
that follows from it (gates, score, contributions, reasons) is made of array
functions in projections, so a cell's evidence is never shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracell.functions import numeric

from .inference import GATED, GATES

PARTS = ("scope", "source", "family", "polarity", "strength", "hard", "detail")
NOTHING = 1e-12

REASONS = {
    "missing_token": "missing-value placeholder", "closed_set_invalid": "not among the column's legal values", "parse_failure": "not readable as the column's type",
    "type_conflict": "of another type than the column", "parser_success": "readable as the column's type", "regex_pass": "fits the column's pattern", "rarity_high": "rare in this column",
    "prototype_close": "close to typical values", "prototype_far": "far from typical values", "cell_parse_failure": "this cell can't be read as the column's type",
    "cell_type_conflict": "this cell has another type than the column", "cell_parser_success": "this cell is readable as the column's type", "pattern_match": "in the column's usual format",
    "pattern_mismatch": "not in the column's usual format", "strong_relationship_violation": "breaks a relation that nearly always holds", "weak_relationship_violation": "breaks a relation that often holds",
    "relationship_satisfied": "keeps its relations to other columns", "local_consistency_pass": "consistent with its row", "local_consistency_fail": "inconsistent with its row",
    "contextual_agreement": "as in rows of the same context", "contextual_disagreement": "unlike rows of the same context", "llm_fd_disagreement": "against an accepted dependency",
}


def _replaced(o: Column, **new: Column) -> Column:
    return F.struct(*[new.get(p, o[p]).alias(p) for p in PARTS])


def one_of_each(cells: DataFrame) -> DataFrame:
    """Of the observations with equal scope, source, polarity and hardness the strongest."""
    key = lambda o: F.struct(*[o[p].alias(p) for p in PARTS if p not in ("strength", "detail")])
    ranked = F.array_sort(F.transform("obs", lambda o: F.struct(key(o).alias("k"), (-o["strength"]).alias("s"), o["detail"].alias("d"))))
    out = cells.withColumn("_r", ranked)
    first = F.filter("_r", lambda r, i: (i == 0) | (r["k"] != F.get("_r", i - 1)["k"]))
    back = F.transform(first, lambda r: F.struct(*[(-r["s"] if p == "strength" else r["d"] if p == "detail" else r["k"][p]).alias(p) for p in PARTS]))
    return out.withColumn("obs", back).drop("_r")


def promoted(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Soft structural missing evidence of these columns becomes full and hard."""
    if not columns:
        return cells
    own = F.col("column").isin(*columns)
    hit = lambda o: own & (o["source"] == "missing_token") & ~o["hard"]
    return cells.withColumn("obs", F.transform("obs", lambda o: _replaced(o, strength=F.when(hit(o), 1.0).otherwise(o["strength"]), hard=hit(o) | o["hard"])))


def rules_scaled(cells: DataFrame, factor: float, sources: tuple[str, ...] = ("pattern_match", "pattern_mismatch")) -> DataFrame:
    """Only the strengths of pattern-rule evidence, times a factor."""
    if not 0 <= factor < float("inf"):
        raise ValueError("the factor must be a finite number of at least 0")
    scaled = lambda o: F.when(o["source"].isin(*sources), F.least(F.lit(1.0), o["strength"] * factor)).otherwise(o["strength"])
    return cells.withColumn("obs", F.transform("obs", lambda o: _replaced(o, strength=scaled(o)))) if factor != 1 else cells


def gate_scales(archetypes: dict[str, str], mode: str = "hard", confidence: dict[str, float] | None = None, support: dict[tuple[str, str], tuple[int, int]] | None = None,
                strength: float = 0.25, pseudocount: float = 2.0, supported: set[tuple[str, str]] | None = None) -> dict[tuple[str, str], float]:
    """What soft evidence of a gated source is multiplied by, by (column, source).

    ``support`` has (clean, dirty) label counts by (archetype, source).
    """
    if mode not in ("hard", "soft", "weak_prior"):
        raise ValueError(f"unknown gating mode {mode}")
    out = {}
    for column, archetype in archetypes.items():
        for source, target in zip(GATED, GATES.get(archetype, ())):
            clean, dirty = (support or {}).get((archetype, source), (0, 0))
            trust = (confidence or {}).get(column, 0.0)
            if mode == "hard":
                out[column, source] = target if supported is None or (archetype, source) in supported else 1.0
            elif mode == "soft":
                out[column, source] = 1.0 if clean <= 0 else 1 - trust * clean / (clean + dirty + 1.0) * (1 - target)
            else:
                prior = min(1.0, max(0.0, strength)) * trust
                total = pseudocount + clean + dirty
                out[column, source] = 1 - ((pseudocount * prior + clean) / total if total > 0 else prior) * (1 - target)
    return out


def gated(cells: DataFrame, scales: dict[tuple[str, str], float]) -> DataFrame:
    """Soft evidence times its gate."""
    live = {k: float(v) for k, v in scales.items() if v != 1.0}
    if not live:
        return cells
    table = F.create_map(*[x for (c, s), v in live.items() for x in (F.lit(f"{c}\0{s}"), F.lit(v))])
    scale = lambda o: F.when(o["hard"], 1.0).otherwise(F.coalesce(F.try_element_at(table, F.concat(F.col("column"), F.lit("\0"), o["source"])), F.lit(1.0)))
    return cells.withColumn("obs", F.transform("obs", lambda o: _replaced(o, strength=F.greatest(F.lit(0.0), F.least(F.lit(1.0), o["strength"] * scale(o))))))


def feature(o: Column) -> Column:
    return F.concat_ws(":", o["scope"], o["family"], o["source"])


def x_of(o: Column) -> Column:
    return F.when(o["polarity"] == "dirty", o["strength"]).when(o["polarity"] == "clean", -o["strength"]).otherwise(0.0)


def weight_of(o: Column, weights: dict[str, float] | None) -> Column:
    if weights is None:
        return F.lit(1.0)
    if not weights:
        return F.lit(0.0)
    return F.coalesce(F.try_element_at(F.create_map(*[x for n, w in weights.items() for x in (F.lit(n), F.lit(float(w)))]), feature(o)), F.lit(0.0))


def vectors(cells: DataFrame) -> DataFrame:
    """row_idx, column and the evidence vector: (feature, x) with 3 decimals, zeros left out."""
    names = F.array_sort(F.array_distinct(F.transform("obs", feature)))
    total = lambda f: F.aggregate(F.filter("obs", lambda o: feature(o) == f), F.lit(0.0), lambda t, o: t + x_of(o))
    pairs = F.transform(names, lambda f: F.struct(f.alias("feature"), F.round(total(f), 3).alias("x")))
    return cells.select("row_idx", "column", F.filter(pairs, lambda p: F.abs(p["x"]) > 1e-9).alias("vector")).where(F.size("vector") > 0)


def scored(cells: DataFrame, intercept: float, weights: dict[str, float] | None) -> DataFrame:
    """Adds logit, posterior and certainty to every cell, those without evidence
    included, and to each observation its contribution: how far the posterior would
    fall without it."""
    total = F.aggregate(F.transform("obs", lambda o: weight_of(o, weights) * x_of(o)), F.lit(float(intercept)), lambda t, w: t + w)
    out = cells.withColumn("logit", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total)))
    out = out.withColumn("posterior", numeric.sigmoid(F.col("logit")))
    gain = lambda o: F.col("posterior") - numeric.sigmoid(F.col("logit") - weight_of(o, weights) * x_of(o))
    added = F.transform("obs", lambda o: F.struct(*[o[p].alias(p) for p in PARTS], gain(o).alias("contribution")))
    return out.withColumn("evidence", added).drop("obs").withColumn("certainty", numeric.certainty(F.col("posterior")))


def _ordered(items: Column) -> Column:
    """By size of contribution, hard ones and stronger ones first among equals."""
    ranked = F.transform(items, lambda e: F.struct((-F.abs(e["contribution"])).alias("a"), (~e["hard"]).alias("b"), (-e["strength"]).alias("c"), e["source"].alias("d"), e["scope"].alias("f"), e.alias("e")))
    return F.transform(F.array_sort(ranked), lambda r: r["e"])


def summary(items: Column, n: int = 6) -> Column:
    """The n hardest and strongest observations in words."""
    ranked = F.array_sort(F.transform(items, lambda e: F.struct((~e["hard"]).alias("a"), (-e["strength"]).alias("b"), e["source"].alias("c"), e["polarity"].alias("p"))))
    told = F.transform(F.slice(ranked, 1, n), lambda r: F.concat(r["c"], F.lit("("), r["p"], F.lit(","), F.format_number(-r["b"], 2), F.lit(")")))
    return F.array_join(told, "; ")


def explained(cells: DataFrame, threshold: float = 0.5, column_thresholds: dict[str, float] | None = None) -> DataFrame:
    """Adds threshold, decision, hard label, reasons and a sentence, by each column's own threshold."""
    limit = F.lit(float(threshold))
    for c, t in (column_thresholds or {}).items():
        limit = F.when(F.col("column") == c, F.lit(float(t))).otherwise(limit)
    d = cells.withColumn("threshold", limit).withColumn("evidence", _ordered(F.col("evidence")))
    dirty = F.col("posterior") >= F.col("threshold")
    up, down = F.filter("evidence", lambda e: e["contribution"] > NOTHING), F.filter("evidence", lambda e: e["contribution"] < -NOTHING)
    d = d.withColumn("_pro", F.when(dirty, up).otherwise(down)).withColumn("_con", F.when(dirty, down).otherwise(up))
    names = lambda arr, a, n: F.array_join(F.transform(F.slice(arr, a, n), lambda e: e["source"]), ",")
    hard = F.filter("evidence", lambda e: e["hard"])
    words = F.create_map(*[x for k, v in REASONS.items() for x in (F.lit(k), F.lit(v))])
    phrase = lambda e: F.coalesce(F.try_element_at(words, e["source"]), F.regexp_replace(e["source"], "_", " "))
    told = lambda e: F.concat(phrase(e), F.coalesce(F.concat(F.lit(" ("), e["detail"], F.lit(")")), F.lit("")))
    said = lambda arr, a, n: F.array_join(F.transform(F.slice(arr, a, n), told), "; ")
    d = d.withColumn("decision", F.when(dirty, "dirty").otherwise("clean")).withColumn("primary_reason", names("_pro", 1, 1)).withColumn("supporting", names("_pro", 2, 3)).withColumn("counter", names("_con", 1, 3))
    d = d.withColumn("hard_label", F.when(F.exists(hard, lambda e: e["polarity"] == "dirty"), "hard_dirty").when(F.size(hard) > 0, "hard_clean").otherwise(""))
    d = d.withColumn("hard_reasons", F.array_join(F.array_sort(F.array_distinct(F.transform(hard, lambda e: e["source"]))), ","))
    shown = F.coalesce(F.substring("raw", 1, 80), F.lit("(null)")) if "raw" in cells.columns else F.lit("")
    sentence = F.concat(
        F.lit("'"), shown, F.lit("' in "), F.col("column"), F.when(dirty, " is suspicious").otherwise(" is not suspicious"), F.lit(" ("), F.format_number("posterior", 3),
        F.when(dirty, " >= ").otherwise(" < "), F.format_number("threshold", 3), F.lit(")"), F.when(F.size("_pro") > 0, F.concat(F.lit(": "), said("_pro", 1, 4))).otherwise(""),
        F.when(F.size("_con") > 0, F.concat(F.lit("; against it: "), said("_con", 1, 3))).otherwise(""), F.lit("."))
    return d.withColumn("explanation", sentence).drop("_pro", "_con")
