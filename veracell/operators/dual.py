"""Pairs of clean and dirty rules: zones, topology, refinement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import Rule, compile_rule


def all_of(df: DataFrame, rules: list[Rule]) -> Column:
    return reduce(lambda a, b: a & b, [compile_rule(r.text, r.column, df.columns) for r in rules], F.lit(True))


def any_of(df: DataFrame, rules: list[Rule]) -> Column:
    return reduce(lambda a, b: a | b, [compile_rule(r.text, r.column, df.columns) for r in rules], F.lit(False))


def zones(df: DataFrame, clean: list[Rule], dirty: list[Rule]) -> DataFrame:
    """The rows with both predicates and their zone."""
    d = df.withColumn("p_clean", all_of(df, clean)).withColumn("p_dirty", any_of(df, dirty))
    c, x = F.col("p_clean"), F.col("p_dirty")
    return d.withColumn("zone", F.when(c & x, "conflict").when(c, "clean").when(x, "dirty").otherwise("grey"))


def four_zones(zoned: DataFrame) -> DataFrame:
    """n and rate of each zone that occurs."""
    counts = zoned.groupBy("zone").agg(F.count("*").alias("n"))
    return counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy()))  # four rows


def zone_samples(zoned: DataFrame, column: str, n: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("zone").orderBy("row_idx")).cast("bigint")
    return zoned.select("zone", "row_idx", column).withColumn("rank", rank).where(F.col("rank") <= n)


def status(rates: dict[str, float], grey_tolerance: float = 0.0, prior: float | None = None) -> str:
    dirty = rates.get("dirty", 0.0)
    if dirty == 1.0:
        return "reject_all_dirty"
    if rates.get("conflict", 0.0) > 0:
        return "reject_conflict"
    if rates.get("grey", 0.0) > grey_tolerance:
        return "reject_gap"
    if prior is not None and dirty > min(0.95, prior * 3):
        return "reject_dirty_prior"
    return "accept_all_clean" if dirty == 0 else "accept"


def topology(zoned: DataFrame) -> DataFrame:
    """Sizes, overlap and kind of the clean and dirty sets; one row."""
    s = zoned.agg(F.count_if("p_clean").alias("n_clean"), F.count_if("p_dirty").alias("n_dirty"), F.count_if(F.col("p_clean") & F.col("p_dirty")).alias("n_both"))
    c, d, b = (F.col(x).cast("double") for x in ("n_clean", "n_dirty", "n_both"))
    kind = F.when((c == 0) | (d == 0) | (b == 0), "disjoint").when(b / d >= 0.8, "subset").when(b / c >= 0.8, "superset").otherwise("intersect")
    return s.select("*", F.when(c + d - b > 0, b / (c + d - b)).otherwise(0.0).alias("iou"), kind.alias("kind"))


def strategy(kind: str) -> str:
    """What refinement a topology asks for."""
    return {"disjoint": "none", "subset": "narrow_clean", "superset": "narrow_dirty", "intersect": "split_overlap"}[kind]


def errors(df: DataFrame, dirty: list[Rule], clean: list[Rule], mode: str = "and_or") -> DataFrame:
    """row_idx, hits: or_only flags any dirty rule; and_or also asks that some
    clean rule fails."""
    hits = [F.when(compile_rule(r.text, r.column, df.columns), F.lit(r.name)) for r in dirty]
    d = df.select("row_idx", F.array_compact(F.array(*hits)).alias("hits"), all_of(df, clean).alias("ok"))
    bad = F.size("hits") > 0
    return d.where(bad & ~F.col("ok") if mode == "and_or" else bad).select("row_idx", F.array_join("hits", ",").alias("hits"))


def gap_values(zoned: DataFrame, column: str, n: int = 10) -> DataFrame:
    return zoned.where("zone = 'grey'").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_first()).limit(n)


def conflict_values(df: DataFrame, column: str, clean: list[Rule], dirty: list[Rule], n: int = 10) -> DataFrame:
    """Values that are clean and also dirty by some rule, by rule."""
    hits = F.array_compact(F.array(*[F.when(compile_rule(r.text, r.column, df.columns), F.lit(r.name)) for r in dirty]))
    d = df.where(all_of(df, clean)).select(F.col(column).alias("value"), F.explode(hits).alias("rule"))
    rank = F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("n"), "value")).cast("bigint")
    return d.groupBy("rule", "value").agg(F.count("*").alias("n")).withColumn("rank", rank).where(F.col("rank") <= n)


def refine(df: DataFrame, clean: list[Rule], dirty: list[Rule], proposals: list[tuple[list[Rule], list[Rule]]], tolerance: float = 0.01, rounds: int = 10) -> tuple[list[Rule], list[Rule], list[dict]]:
    """Takes each proposal that lowers conflict plus grey, and drops one that
    raises it; stops when both are within the tolerance. One aggregation a round."""

    def measure(c, d):
        r = {x.zone: x.rate for x in four_zones(zones(df, c, d)).collect()}  # four rows
        return r.get("conflict", 0.0), r.get("grey", 0.0)

    best, log = measure(clean, dirty), []
    for c, d in proposals[:rounds]:
        if max(best) <= tolerance:
            break
        got = measure(c, d)
        taken = sum(got) < sum(best)
        log.append({"conflict": got[0], "grey": got[1], "taken": taken})
        if taken:
            clean, dirty, best = c, d, got
    return clean, dirty, log


def dirty_prior(kind: str, n_rows: int, n_missing: int, unique_ratio: float | None = None, default: float = 0.1) -> float:
    """The share of dirty cells to expect of a column from its profile."""
    if not n_rows:
        return default
    gone = n_missing / n_rows
    prior = max({"text": 0.2, "categorical": 0.15, "pattern": 0.12}.get(kind, 0.1), min(0.3, gone + 0.05))
    if unique_ratio is not None and unique_ratio > 0.9:
        prior = min(prior, 0.08)
    if gone > 0.4:
        prior = max(prior, min(0.5, gone + 0.05))
    return max(0.02, min(0.5, prior))


def disjointness(df: DataFrame, pairs: dict[str, tuple[list[Rule], list[Rule]]]) -> DataFrame:
    """For each column's clean and dirty rules: rows that both take, coverage of
    each, the share neither takes, and whether they are disjoint; one aggregation."""
    share = lambda c: F.avg(c.cast("double"))
    aggs, each = [], []
    for k, (column, (clean, dirty)) in enumerate(pairs.items()):
        c, x = all_of(df, clean), any_of(df, dirty)
        aggs += [F.count_if(c & x).alias(f"b{k}"), share(c).alias(f"c{k}"), share(x).alias(f"d{k}"), share(~c & ~x).alias(f"g{k}")]
        each.append(F.struct(F.lit(column).alias("column"), F.col(f"b{k}").alias("n_both"), F.col(f"c{k}").alias("clean_rate"), F.col(f"d{k}").alias("dirty_rate"),
                             F.col(f"g{k}").alias("gap_rate"), (F.col(f"b{k}") == 0).alias("disjoint")))
    return df.agg(*aggs).select(F.inline(F.array(*each)))


def false_counts(zoned: DataFrame, clean: list[Rule], columns: list[str]) -> DataFrame:
    """In the grey zone, how many rows each clean rule alone refuses."""
    grey = zoned.where("zone = 'grey'")
    one = grey.agg(*[F.count_if(~compile_rule(r.text, r.column, columns)).alias(f"_{k}") for k, r in enumerate(clean)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"_{k}").alias("n_false")) for k, r in enumerate(clean)])))


def resolve_gap(df: DataFrame, clean: list[Rule], dirty: list[Rule], column: str, most: int = 10) -> tuple[list[Rule], list[dict]]:
    """Widens the clean rule that refuses most of the grey zone by the zone's most
    frequent values; kept only if the zone shrinks and no conflict appears."""
    zoned = zones(df, clean, dirty)
    refusals = false_counts(zoned, clean, df.columns).orderBy(F.desc("n_false"), "rule").collect()  # a row a rule
    values = [r.value for r in gap_values(zoned, column, most).collect() if r.value is not None]
    worst = next((r for f in refusals for r in clean if r.name == f.rule and r.column == column and f.n_false), None)
    if worst is None or not values:
        return clean, []
    body = worst.text.split(":", 1)[1].strip()
    wider = Rule(worst.name, worst.column, worst.family, f"lambda value, row=None: ({body}) or value in {tuple(sorted(map(str, values)))!r}")
    proposal = [wider if r is worst else r for r in clean]
    new, _, log = refine(df, clean, dirty, [(proposal, dirty)], tolerance=0.0)
    return new, log


def resolve_conflict(df: DataFrame, clean: list[Rule], dirty: list[Rule], column: str, most: int = 10) -> tuple[list[Rule], list[dict]]:
    """Narrows, pair by pair, each dirty rule by the values that are clean as well;
    all that lower conflict and grey together are kept."""
    hits: dict[str, list[str]] = {}
    for r in conflict_values(df, column, clean, dirty, most).collect():  # at most ``most`` a rule
        if r.value is not None:
            hits.setdefault(r.rule, []).append(str(r.value))
    log: list[dict] = []
    for rule in list(dirty):
        if rule.name not in hits or rule.column != column:
            continue
        body = rule.text.split(":", 1)[1].strip()
        narrow = Rule(rule.name, rule.column, rule.family, f"lambda value, row=None: ({body}) and value not in {tuple(sorted(hits[rule.name]))!r}")
        _, dirty, more = refine(df, clean, dirty, [(clean, [narrow if r.name == rule.name else r for r in dirty])], tolerance=0.0)
        log += more
    return dirty, log


def refine_pair(df: DataFrame, clean: list[Rule], dirty: list[Rule], column: str, rounds: int = 3, tolerance: float = 0.01) -> tuple[list[Rule], list[Rule], list[dict]]:
    """Gap, then conflict, round by round, until neither moves or both are small."""
    log: list[dict] = []
    for _ in range(rounds):
        clean, a = resolve_gap(df, clean, dirty, column)
        dirty, b = resolve_conflict(df, clean, dirty, column)
        log += a + b
        if not any(e["taken"] for e in a + b) or max((a + b)[-1]["conflict"], (a + b)[-1]["grey"]) <= tolerance:
            break
    return clean, dirty, log


def report(df: DataFrame, clean: list[Rule], dirty: list[Rule], prior: float | None = None) -> dict:
    """Zone rates, topology, strategy and status of a pair of rule sets."""
    zoned = zones(df, clean, dirty)
    rates = {r.zone: r.rate for r in four_zones(zoned).collect()}  # four rows
    shape = topology(zoned).first()
    return {"rates": rates, "topology": shape.asDict(), "strategy": strategy(shape.kind), "status": status(rates, prior=prior),
            "clean": [r.text for r in clean], "dirty": [r.text for r in dirty]}
