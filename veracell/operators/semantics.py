"""What columns mean: archetypes, relations suggested by names, dependency
candidates and their validation, pattern search."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracell.functions import text

from . import relations as rel
from .profile import exemplar_regex

IDENTIFIERS = frozenset("id provider_number zip_code zipcode postal_code phone_number phonenumber flight".split())
_NAMED = (
    ("temporal_measure", lambda n, snake, parts: parts & set("time date datetime timestamp year duration".split()) or snake.endswith("_at")),
    ("identifier", lambda n, snake, parts: {n, snake} & IDENTIFIERS or n.endswith(("_id", "identifier"))),
    ("geo_name", lambda n, snake, parts: parts & set("city town province region".split())),
    ("closed_enum", lambda n, snake, parts: snake in ("state", "state_code", "country_code") or parts & set("status category style".split())),
    ("unit_measure", lambda n, snake, parts: any(u in n for u in ("ounce", "weight", "unit", "size"))),
)
MECHANISMS = {
    "closed_enum": ("misspelling", "wrong_category", "missing"), "identifier": ("format", "duplicate", "missing"), "open_entity": ("misspelling", "truncation", "missing"), "geo_name": ("misspelling", "extra_token", "missing"),
    "numeric_measure": ("scale", "outlier", "format", "missing"), "unit_measure": ("unit_suffix", "scale", "missing"), "temporal_measure": ("format", "order", "missing"), "free_text": ("encoding", "truncation", "missing"),
}
NEED = {"unit_measure": 0.95, "geo_name": 0.80, "numeric_measure": 0.45, "temporal_measure": 0.30, "closed_enum": 0.40, "identifier": 0.35, "open_entity": 0.25, "free_text": 0.20}


@dataclass(frozen=True)
class Semantics:
    column: str
    archetype: str
    open_set: float
    structure: float
    need: float
    mechanisms: tuple[str, ...]
    confidence: float = 0.65


def archetype(column: str, kind: str, unique_ratio: float = 0.0, top_coverage: float = 0.0, shape_coverage: float = 0.0, percent_ratio: float = 0.0) -> Semantics:
    """From the name first, then from how values are spread. A one-letter table
    prefix (``p_size``) is not part of the name."""
    bare = re.sub(r"^[a-z]{1,2}_", "", column.strip().lower()) or column.lower()
    snake = re.sub(r"^[a-z]{1,2}_", "", re.sub(r"(?<!^)(?=[A-Z])", "_", column.strip()).lower())
    parts = set(filter(None, re.split(r"[^a-z0-9]+", snake)))
    found = next((a for a, test in _NAMED if test(bare, snake, parts)), None)
    if found is None:
        if kind == "numeric" or parts & set("abv amount price rate score average avg".split()) or bare.endswith("avg"):
            found = "numeric_measure"
        elif "name" in bare or unique_ratio >= 0.50:
            found = "open_entity"
        else:
            found = "closed_enum" if unique_ratio <= 0.10 and top_coverage >= 0.30 else "free_text"
    need = max(NEED[found], percent_ratio) if found == "numeric_measure" else NEED[found]
    return Semantics(column, found, min(1.0, max(0.0, unique_ratio)), max(top_coverage, shape_coverage), need, MECHANISMS[found])


def named_relations(columns: list[str]) -> list[tuple[str, str, str]]:
    """(column, other column, kind) that the names alone suggest."""
    at = {c.lower(): c for c in columns}
    state, city, postal = at.get("state"), at.get("city"), at.get("zipcode") or at.get("zip")
    out = []
    for c in columns:
        low = c.lower()
        for other, word, kind in ((state, "state", "prefix_match"), (city, "city", "contains"), (state, "stateavg", "stateavg_format"), (postal, "zip", "zip_prefix")):
            if other and c != other and word in low:
                out.append((c, other, kind))
    return out


def families(kind: str, has_patterns: bool, has_relations: bool, has_prototypes: bool) -> list[str]:
    out = ["missing", "outlier"]
    out += ["pattern"] * (has_patterns or kind == "pattern") + ["relationship"] * has_relations + ["prototype_lexical"] * (has_prototypes and kind != "numeric")
    return out


DETERMINANTS, DEPENDENTS = ("identifier", "closed_enum"), ("identifier", "closed_enum", "temporal_measure")


def dependency_candidates(df: DataFrame, archetypes: dict[str, str], least_group: int = 3, n: int = 24) -> DataFrame:
    """Column pairs worth proposing as dependencies: predictiveness, repeated
    groups, their sizes and dominance; taken in turn from each determinant."""
    columns = [c for c in df.columns if c in archetypes]
    counts = rel.pair_counts(df, columns).where(~F.col("tgt_sig").isin("<na>", "<empty>"))
    left = [c for c in columns if archetypes[c] in DETERMINANTS]
    right = [c for c in columns if archetypes[c] in DEPENDENTS]
    counts = counts.where(F.col("ctx").isin(left) & F.col("tgt").isin(right))
    groups = rel.modes(counts).where(F.col("g") >= least_group)
    half = lambda c: F.percentile(c, F.lit(0.5))
    stats = groups.groupBy("ctx", "tgt").agg(F.count("*").alias("n_groups"), half(F.col("g").cast("double")).alias("median_size"), F.max("g").alias("max_size"), half(F.col("mode_n") / F.col("g")).alias("median_share"))
    both = stats.join(rel.predictiveness(counts), ["ctx", "tgt"])
    turn = F.row_number().over(Window.partitionBy("ctx").orderBy(F.desc(F.round("predictiveness", 4)), F.desc("max_size"), "tgt")).cast("bigint")
    return both.withColumn("turn", turn).orderBy("turn", "ctx").limit(n)  # a row a column pair


def judge_dependency(proposal: dict, columns: list[str], viable: set[tuple[str, str]], seen: set[str] | None = None) -> str:
    """``accepted`` or the first reason a proposed dependency is refused."""
    left, right = proposal.get("determinant_columns"), proposal.get("dependent_column")
    grain, change = proposal.get("determinant_granularity"), proposal.get("dependent_variability")
    one = left[0] if isinstance(left, list) and len(left) == 1 else None
    rule = str(proposal.get("rule_id") or "").strip() or f"fd_{one}_{right}"
    checks = (
        (proposal.get("scope") != "cross_row", "unsupported_scope"), (proposal.get("type") != "functional_dependency", "unsupported_type"), (not isinstance(left, list) or len(left) != 1, "requires_one_determinant_column"),
        (not isinstance(one, str) or not isinstance(right, str), "invalid_column_name"), (grain not in ("instance", "recurring_entity", "unknown"), "invalid_determinant_granularity"),
        (change not in ("invariant", "instance_varying", "unknown"), "invalid_dependent_variability"), ("unknown" in (grain, change), "ambiguous_semantic_granularity"),
        ((grain, change) == ("recurring_entity", "instance_varying"), "instance_varying_dependent_requires_instance_key"), (one not in columns or right not in columns, "unknown_column"),
        (one == right, "same_determinant_and_dependent"), ((one, right) not in viable, "not_a_statistically_viable_candidate"), (seen is not None and rule in seen, "duplicate_rule_id"),
    )
    for bad, why in checks:
        if bad:
            return why
    if seen is not None:
        seen.add(rule)
    return "accepted"


def dependency_disagreement(df: DataFrame, determinant: str, dependent: str, least_group: int = 3, least_mode: int = 2, least_share: float = 0.5) -> DataFrame:
    """Cells against the majority of their group under an accepted dependency,
    which may rest on weaker support than consensus; ties say nothing."""
    counts = rel.pair_counts(df, [determinant, dependent]).where((F.col("ctx") == determinant) & (F.col("tgt") == dependent))
    predictive = rel.predictiveness(counts).select("predictiveness")  # one row
    groups = rel.modes(counts).where((F.col("g") >= least_group) & (F.col("mode_n") >= least_mode) & (F.col("mode_n") / F.col("g") >= least_share))
    own = counts.select("ctx_sig", "tgt_sig", F.col("n").alias("own"))
    rows = df.select("row_idx", text.signature(F.col(determinant).cast("string")).alias("ctx_sig"), text.signature(F.col(dependent).cast("string")).alias("tgt_sig"))
    met = rows.join(groups.select("ctx_sig", "g", "mode_sig", "mode_n"), "ctx_sig").join(own, ["ctx_sig", "tgt_sig"]).where((F.col("tgt_sig") != F.col("mode_sig")) & (F.col("mode_n") > F.col("own")))
    base = F.least(F.lit(1.0), F.col("predictiveness") * F.log(F.col("g").cast("double")) / F.log(F.lit(float(1 + max(df.count(), 2)))))
    return met.crossJoin(F.broadcast(predictive)).select("row_idx", F.lit(dependent).alias("tgt"), F.lit("dirty").alias("polarity"), F.lit(determinant).alias("ctx"), F.col("mode_sig").alias("expected"), (base * (1 - F.col("own") / F.col("g"))).alias("strength"))


def explore_patterns(df: DataFrame, column: str, rounds: int = 3, target: float = 0.98, least: float = 0.05, gain: float = 0.02) -> list[tuple[str, float]]:
    """Patterns of a column with their coverage, found round by round from the
    commonest shapes that are not covered yet; merged after every round."""
    v = F.trim(F.col(column).cast("string"))
    rows = df.where(F.col(column).isNotNull()).select(v.alias("v"), text.explorer_shape(v).alias("s"))
    found: list[tuple[str, float]] = []
    covered = 0.0
    for _ in range(rounds):
        left = rows
        for p, _ in found:
            left = left.where(~text.full_match(F.col("v"), p))
        heads = left.groupBy("s").agg(F.count("*").alias("n"), F.min("v").alias("v")).orderBy(F.desc("n"), "s").limit(10).collect()  # ten shapes
        fresh = [p for p in dict.fromkeys(exemplar_regex(h.v) for h in heads) if p not in dict(found)]
        if not fresh:
            break
        rates = rows.agg(*[F.avg(text.full_match(F.col("v"), p).cast("double")).alias(f"_{k}") for k, p in enumerate(fresh)]).first()
        found += [(p, rates[k]) for k, p in enumerate(fresh) if rates[k] is not None and rates[k] >= least]
        before, covered = covered, rows.agg(F.avg(text.full_match(F.col("v"), "|".join(f"(?:{p})" for p, _ in found)).cast("double"))).first()[0] if found else 0.0
        if covered >= target or covered - before < gain:
            break
    return sorted(found, key=lambda x: (-x[1], x[0]))


def pattern_rule(patterns: list[tuple[str, float]]) -> str | None:
    """A rule that any of the patterns holds for the whole value."""
    if not patterns:
        return None
    either = "|".join(f"(?:{p})" for p, _ in patterns)
    return f"lambda value, row=None: bool(re.fullmatch({either!r}, str(value)))"
