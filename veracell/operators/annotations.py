"""Annotated experiments: alignment, joins to traces, grids of results."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracell.functions import numeric


def normalised(v: Column) -> Column:
    """Null words become <NA>, numbers one spelling, text lower case."""
    t = F.lower(F.trim(v))
    number = t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(v.isNull() | t.isin("", "nan", "none", "null", "na", "n/a", "<na>"), "<NA>").when(number, F.regexp_replace(plain, r"^(-?)0+(?=\d)", "$1")).otherwise(t)


def aligned(notes: DataFrame, dirty: DataFrame, clean: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Annotations with whether their key is known and their two values are the
    tables'; values the wrong way round are turned."""
    long = lambda df, n: df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias(n)) for c in columns])).alias("p")).select(key, "p.*")
    j = notes.join(long(dirty, "dirty_value"), [key, "column"], "left").join(long(clean, "clean_value"), [key, "column"], "left")
    same = lambda a, b: normalised(F.col(a)) == normalised(F.col(b))
    known = F.col("dirty_value").isNotNull() | F.col("clean_value").isNotNull()
    turned = same("error_value", "clean_value") & same("right_value", "dirty_value") & ~same("error_value", "dirty_value")
    return j.select(*notes.columns, known.alias("valid_key"), same("error_value", "dirty_value").alias("error_matches"), same("right_value", "clean_value").alias("right_matches"), turned.alias("turned"))


def on_traces(notes: DataFrame, traces: DataFrame) -> DataFrame:
    """Each annotation with its cell's trace, if it has one."""
    t = traces.select(F.col("row_index").alias("row_idx"), "column", "posterior", "decision", "evidence")
    return notes.join(t, ["row_idx", "column"], "left").withColumn("detected", F.coalesce(F.col("decision") == "dirty", F.lit(False)))


def determinants(constraint: Column) -> Column:
    """Column names t1.X that a written constraint compares."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(constraint, F.lit(r"t[12]\.([A-Za-z_][A-Za-z0-9_]*)"), 1)))


def tuple_rows(pairs: Column) -> Column:
    """Row numbers inside a written list of tuple pairs."""
    return F.transform(F.regexp_extract_all(pairs, F.lit(r"(\d+)"), 1), lambda x: x.cast("bigint"))


def weakest_rule(hits: DataFrame) -> DataFrame:
    """For each cell the violated rule with the smallest violation rate."""
    return hits.groupBy("row_idx", "column").agg(F.min_by("rule", F.struct("rate", "rule")).alias("rule"), F.min("rate").alias("rate"))


def set_counts(found: DataFrame, true: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of what both, only the first and only the second table hold."""
    a, b = found.select(*keys).distinct().withColumn("_a", F.lit(1)), true.select(*keys).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, keys, "full_outer")
    return j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("tp"), F.count_if(F.col("_b").isNull()).alias("fp"), F.count_if(F.col("_a").isNull()).alias("fn"))


def grid(results: DataFrame, by: list[str], measure: str) -> DataFrame:
    return results.groupBy(*by).agg(F.round(F.avg(measure), 6).alias("mean"), F.min(measure).alias("low"), F.max(measure).alias("high"), F.count("*").alias("n"))


def grounded(trace: DataFrame) -> DataFrame:
    """Share of a trace's evidence that names a source, a direction and a
    contribution that agrees with the direction."""
    e = trace.select("row_index", "column", F.explode("evidence").alias("e"))
    agrees = F.when(F.col("e.polarity") == "dirty", F.col("e.contribution") >= 0).otherwise(F.col("e.contribution") <= 0)
    return e.groupBy("row_index", "column").agg(F.count("*").alias("n"), F.avg((F.col("e.source").isNotNull() & agrees).cast("double")).alias("grounded"))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks; there is no built-in for it."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def looks_like_typo(a: Column, b: Column, least: float = 0.85) -> Column:
    """Different, but with matching blocks of ``least`` of both lengths. Blocks that
    match are at most what no edit touches: only pairs that pass that bound in the
    JVM reach Python."""
    n, m = F.length(a), F.length(b)
    # each edit leaves one character of one side unmatched, or of both
    most = n + m - F.greatest(F.abs(n - m), F.levenshtein(a, b))
    near = (a != b) & (most >= least * (n + m))
    return near & F.coalesce(sequence_ratio(F.when(near, a), F.when(near, b)) >= least, F.lit(False))


def made_errors(seeds: DataFrame, column: str, family: str) -> DataFrame:
    """Deliberately wrong values of one family from clean ones. ``relationship`` takes
    the next of the values that share a bucket of 64."""
    v = F.col(column).cast("string")
    blank = F.element_at(F.array(*map(F.lit, ("", "n/a", "null"))), (numeric.hash_bucket(v, 3) + 1).cast("int"))
    wrong = {
        "missing": blank, "pattern": F.concat(v, F.lit("#?")),
        "outlier": F.when(v.rlike(r"^-?\d+(\.\d+)?$"), (v.try_cast("double") * 1000).cast("string")).otherwise(F.repeat(v, 3)),
        "relationship": F.lead(v).over(Window.partitionBy(numeric.hash_bucket(v, 64)).orderBy(v)),
    }
    if family not in wrong:
        raise ValueError(f"unknown family {family}")
    return seeds.select(v.alias("clean"), wrong[family].alias("wrong"), F.lit(family).alias("family")).where("not (clean <=> wrong) and wrong is not null")
