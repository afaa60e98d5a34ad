"""Proposals for a table: from files bound to it, or made without any model.

Whoever proposes rules, dependencies or repairs writes them to a cache file that
names the table's columns and fingerprint. What is loaded is judged again on the
table itself before it counts; a file of another table is ignored, and then the
deterministic fallbacks take its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracell.functions import numeric, text
from veracell.operators import cells as ce
from veracell.operators import rules as ru
from veracell.operators import semantics as se
from veracell.operators.rules import Rule
from veracell.sources.sinks import ProposalCache

AGENT = {v: k for k, v in ru.FAMILY.items()}


def fallbacks(df: DataFrame, kinds: dict[str, str], samples: int = 20) -> dict[str, list[tuple[str, str]]]:
    """(agent, rule text) by column: completeness, ranges or lengths, forms, and
    relations that names suggest. Two aggregations, of which a row a column and
    ``samples`` values a column are collected."""
    cell = ce.cells(df, list(kinds))
    x, size = numeric.strict(F.col("raw")), F.length(F.trim("raw"))
    spans = cell.where(~text.missing_like(F.col("raw"))).groupBy("column").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.min(size).alias("short"), F.max(size).alias("long"))
    spans = {r.column: r for r in spans.collect()}
    heads: dict[str, list[str]] = {}
    kept = ce.values(cell).where(~text.missing_like(F.col("first_raw"))).withColumnRenamed("support", "n")
    for r in ce.top(kept, ["column"], samples, ["first_row"]).orderBy("column", "rank").collect():
        heads.setdefault(r.column, []).append(r.first_raw)
    out: dict[str, list[tuple[str, str]]] = {}
    tokens = tuple(t for t in text.RULE_MISSING if t)
    for column, kind in kinds.items():
        s, made = spans.get(column), []
        if s is None:
            made = ru.fallback_rules(column, "categorical", tokens=tokens)
        elif kind == "numeric" and s.lo is not None:
            made = ru.fallback_rules(column, kind, s.lo, s.hi, tokens=tokens)
        else:
            made = ru.fallback_rules(column, kind, lengths=(s.short, s.long), tokens=tokens)
            made += ru.pattern_fallbacks(column, heads.get(column, []))
        out[column] = [(AGENT[r.family], r.text) for r in made]
    for r in ru.relation_rules([x for x in se.named_relations(list(kinds)) if x[0] in kinds]):
        out[r.column].append(("column_relationship", r.text))
    return out


def rule_pool(df: DataFrame, kinds: dict[str, str], cache: ProposalCache | None = None, least: float = 0.5) -> tuple[dict[str, list[Rule]], list[dict], str]:
    """Accepted rules by column, every proposal with its verdict, and where the
    proposals came from: ``file`` or ``fallback``. ``df`` has row_idx."""
    items, source = None, "fallback"
    if cache is not None:
        fingerprint = ce.fingerprint(df).first().sha256
        if (stored := cache.load(list(kinds), fingerprint)) is not None:
            items, source = {}, "file"
            for column, agent, rule in stored:
                items.setdefault(column, []).append((agent, rule))
    if items is None:
        items = fallbacks(df, kinds)
        if cache is not None:
            cache.save(list(kinds), fingerprint, [[c, a, t] for c, own in items.items() for a, t in own])
    pool, log = ru.rule_pool(df, items, least)
    return pool, log, source


def dependencies(proposals: list[dict], df: DataFrame, archetypes: dict[str, str]) -> tuple[frozenset[tuple[str, str]], list[tuple[dict, str]]]:
    """The accepted (determinant, dependent) pairs of proposed dependencies, and
    each proposal with its verdict; only pairs among the table's own candidates count."""
    viable = {(r.ctx, r.tgt) for r in se.dependency_candidates(df, archetypes).collect()}  # at most 24
    seen: set[str] = set()
    log = [(p, se.judge_dependency(p, df.columns, viable, seen)) for p in proposals]
    return frozenset((p["determinant_columns"][0], p["dependent_column"]) for p, v in log if v == "accepted"), log
