"""A small repair language: operations, their validation, ranked candidates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracell.functions import numeric, text

KINDS = ("regex_replace", "strip_suffix", "split_trailing_token", "truncate_at_marker", "normalize_surface")


#: Characters that an operation may be written with.
PLAN_CHARS = 4000


@dataclass(frozen=True)
class Operation:
    kind: str
    column: str
    confidence: float = 0.8
    ambiguity: float = 0.0
    pattern: str = ""
    replacement: str = ""
    suffix: str = ""
    scale: float = 1.0
    marker: str = ""
    target: str = ""
    mapping: dict = field(default_factory=dict, hash=False)


def check(op: Operation) -> str:
    """``ok`` or what is wrong with the operation's form."""
    if op.kind not in KINDS:
        return "unknown_operation"
    if not 0.5 <= op.confidence <= 1:
        return "low_confidence"
    if len(op.pattern) > 500:
        return "pattern_too_long"
    if len(op.pattern) + len(op.replacement) + len(op.suffix) + len(op.marker) + sum(len(str(x)) for kv in op.mapping.items() for x in kv) > PLAN_CHARS:
        return "plan_too_long"
    if op.kind == "regex_replace":
        try:
            re.compile(op.pattern)
        except re.error:
            return "bad_pattern"
    if {"regex_replace": op.pattern, "strip_suffix": op.suffix, "split_trailing_token": op.target, "truncate_at_marker": op.marker, "normalize_surface": op.mapping}[op.kind] in ("", {}):
        return "missing_argument"
    return "ok"


def applied(op: Operation) -> Column:
    """The operation's new value, null where it changes nothing."""
    v = F.col(f"`{op.column}`").cast("string")
    t = F.trim(v)
    if op.kind == "regex_replace":
        new = F.regexp_replace(t, f"(?i){op.pattern}", op.replacement)
    elif op.kind == "strip_suffix":
        body = F.trim(F.expr(f"substring(trim(`{op.column}`), 1, length(trim(`{op.column}`)) - {len(op.suffix)})"))
        new = F.when(t.endswith(op.suffix), body if op.scale == 1.0 else (numeric.strict(body) * op.scale).cast("string"))
    elif op.kind == "split_trailing_token":
        new = F.regexp_extract(t, r"^(.*\S)\s+\S+$", 1)
    elif op.kind == "truncate_at_marker":
        new = F.when(F.locate(op.marker, t) > 1, F.trim(F.substring_index(t, op.marker, 1)))
    else:
        new = t
        for old in sorted(op.mapping, key=lambda k: (-len(k), k)):  # longest first
            new = F.regexp_replace(new, r"(?i)(?<![A-Za-z0-9])" + re.escape(old) + r"(?![A-Za-z0-9])", op.mapping[old])
    return F.when((new != t) & (new != ""), new)


def trailing(column: str) -> Column:
    return F.regexp_extract(F.trim(column), r"\s(\S+)$", 1)


def candidates(df: DataFrame, ops: list[Operation]) -> DataFrame:
    """row_idx, column, mechanism, candidate, score, rank; rules that don't hold
    together are left out. A trailing token counts only if it is a value of the
    reference column."""
    out = None
    for op in ops:
        if check(op) != "ok":
            continue
        d = df.select("row_idx", F.col(f"`{op.column}`").cast("string").alias("_v"), applied(op).alias("candidate"), *([trailing(op.column).alias("_t")] if op.kind == "split_trailing_token" else []))
        if op.kind == "split_trailing_token":
            known = df.select(text.token(F.col(f"`{op.target}`").cast("string")).alias("_k")).distinct()
            d = d.join(known, text.token(F.col("_t")) == F.col("_k"), "left_semi")
        d = d.where("candidate is not null").select("row_idx", F.lit(op.column).alias("column"), F.lit(op.kind).alias("mechanism"), "candidate", F.lit(op.confidence * (1 - 0.10 * op.ambiguity)).alias("score"),
                                                     F.lit(op.ambiguity).alias("ambiguity"), F.to_json(F.create_map(F.lit(op.column), F.col("candidate"))).alias("changed"))
        out = d if out is None else out.unionByName(d)
    if out is None:
        return df.sparkSession.createDataFrame([], "row_idx bigint, column string, mechanism string, candidate string, score double, ambiguity double, changed string, rank bigint")
    rank = F.row_number().over(Window.partitionBy("row_idx", "column").orderBy(F.desc("score"), "mechanism")).cast("bigint")
    return out.withColumn("rank", rank)


def validated(df: DataFrame, ops: list[Operation], contract: dict[str, str], least_support: float = 0.0, most_rewritten: float = 0.5) -> list[tuple[Operation, str]]:
    """Each operation with ``ok`` or why it is dropped: form, too few or too many
    cells rewritten, or results that miss the column's pattern. One aggregation."""
    formed = [(op, check(op)) for op in ops]
    good = [op for op, s in formed if s == "ok"]
    aggs = []
    for k, op in enumerate(good):
        new = applied(op)
        fits = text.full_match(new, contract[op.column]) if op.column in contract else F.lit(True)
        aggs += [F.count(new).alias(f"n{k}"), F.count_if(new.isNotNull() & fits).alias(f"f{k}")]
    row = df.agg(F.count("*").alias("n"), *aggs).first() if good else None
    out = [(op, s) for op, s in formed if s != "ok"]
    for k, op in enumerate(good):
        n, fit = row[f"n{k}"], row[f"f{k}"]
        share = n / max(1, row["n"])
        out.append((op, "no_match" if not n or share < least_support else "mass_rewrite" if share > most_rewritten else "contract_missed" if fit / n < 0.80 else "ok"))
    return out


def repair_evidence(cand: DataFrame) -> DataFrame:
    """Each cell's best candidate as dirty evidence of its own family."""
    return cand.where("rank = 1").select("row_idx", "column", F.lit("cell").alias("scope"), F.concat(F.lit("canonicalization_"), F.col("mechanism")).alias("source"), F.lit("canonicalization").alias("family"),
                                         F.lit("dirty").alias("polarity"), F.col("score").alias("strength"), F.lit(False).alias("hard"),
                                         F.concat(F.lit("candidate "), F.col("candidate")).alias("detail"))
