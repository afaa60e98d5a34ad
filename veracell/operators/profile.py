"""Column profiles: each measure of all columns in one pass over the cells."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracell.functions import numeric, text

from . import quantiles
from .cells import top

PERCENTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def null_counts(cell: DataFrame) -> DataFrame:
    """column, n_rows, n_null, n_missing (null or a missing token)."""
    raw = F.col("raw")
    return cell.groupBy("column").agg(F.count("*").alias("n_rows"), F.count_if(raw.isNull()).alias("n_null"),
                                      F.count_if(raw.isNull() | text.token(raw).isin(*text.PROFILE_MISSING)).alias("n_missing"))


def missing_tokens(cell: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent missing tokens of each column."""
    t = text.token(F.col("raw"))
    counts = cell.where(F.col("raw").isNotNull() & t.isin(*text.PROFILE_MISSING)).groupBy("column", t.alias("token")).agg(F.count("*").alias("n"))
    return top(counts, ["column"], n, ["token"])


def uniqueness(value: DataFrame) -> DataFrame:
    """unique_count, unique_ratio, singleton_ratio, top10_coverage, percent_ratio by column."""
    kept = value.where("sig <> '<na>'")
    # ranks need all of a column's values sorted; its heaviest ten are found by a bounded top-k instead
    heads = top(kept.select("column", "sig", F.col("support").alias("n")), ["column"], 10, ["sig"]).groupBy("column").agg(F.sum("n").alias("head"))
    base = kept.groupBy("column").agg(F.count("*").alias("unique_count"), F.sum("support").alias("total"), F.count_if(F.col("support") == 1).alias("singles"),
                                      F.sum(F.when(F.col("sig").endswith("%"), F.col("support")).otherwise(0)).alias("percents"))
    return base.join(heads, "column").select("column", "unique_count", (F.col("unique_count") / F.col("total")).alias("unique_ratio"), (F.col("singles") / F.col("unique_count")).alias("singleton_ratio"),
                                             (F.col("head") / F.col("total")).alias("top10_coverage"), (F.col("percents") / F.col("total")).alias("percent_ratio"))


def top_values(value: DataFrame, n: int = 20) -> DataFrame:
    total = value.where("sig <> '<na>'").groupBy("column").agg(F.sum("support").alias("total"))
    best = top(value.where("sig <> '<na>'").withColumnRenamed("support", "n"), ["column"], n, ["first_row"])
    return best.join(F.broadcast(total), "column").select("column", "sig", "n", (F.col("n") / F.col("total")).alias("ratio"), "first_raw", "rank")


def prototypes(value: DataFrame, n: int = 10) -> DataFrame:
    """column, prototype, n, rank and the share that it and those before it cover."""
    cover = F.sum("ratio").over(Window.partitionBy("column").orderBy("rank"))  # n rows a column
    return top_values(value, n).select("column", F.col("first_raw").alias("prototype"), "n", "rank", cover.alias("coverage"))


def low_frequency_values(value: DataFrame, most: int = 3, n: int = 20) -> DataFrame:
    rare = value.where((F.col("sig") != "<na>") & (F.col("support") <= most)).withColumnRenamed("support", "n")
    return top(rare, ["column"], n, ["first_row"]).select("column", "sig", "n", "rank")


def distribution(cell: DataFrame, key, name: str, n: int = 20) -> DataFrame:
    """Top-n of a signature of the cells that aren't null, with its share of them."""
    counts = cell.where(F.col("raw").isNotNull()).groupBy("column", key.alias(name)).agg(F.count("*").alias("n"))
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return top(counts, ["column"], n, [name]).join(F.broadcast(total), "column").select("column", name, "n", (F.col("n") / F.col("total")).alias("ratio"), "rank")


def lengths(cell: DataFrame, n: int = 20) -> DataFrame:
    """The n shortest lengths of each column and how often they are."""
    counts = cell.where(F.col("raw").isNotNull()).groupBy("column", F.length(F.trim("raw")).alias("length")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("length")).cast("bigint")
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def token_support(cell: DataFrame, n: int = 20) -> DataFrame:
    each = cell.where(F.col("raw").isNotNull()).select("column", F.explode(F.regexp_extract_all(F.lower("raw"), F.lit("([a-z0-9]+)"), 1)).alias("token"))
    return top(each.groupBy("column", "token").agg(F.count("*").alias("n")), ["column"], n, ["token"])


def trigram_support(cell: DataFrame, n: int = 20) -> DataFrame:
    """Cells that have a trigram; each counts once."""
    each = cell.where(F.col("raw").isNotNull()).select("column", F.explode(text.ngrams(text.collapsed(F.col("raw")))).alias("gram"))
    return top(each.groupBy("column", "gram").agg(F.count("*").alias("n")), ["column"], n, ["gram"])


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: moments in one aggregation, exact percentiles beside it."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")))
    out = df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
    q = quantiles.exact(quantiles.of_columns(df, columns), list(PERCENTILES.values()))
    rows = df.sparkSession.createDataFrame([(c, *v) for c, v in q.items()], "column string, " + ", ".join(f"{p} double" for p in PERCENTILES))
    return out.join(F.broadcast(rows), "column", "left").withColumn("iqr", F.col("p75") - F.col("p25"))


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, median, mad: a second selection over deviations from the first's medians."""
    middle = {c: v[0] for c, v in quantiles.exact(quantiles.of_columns(df, columns), [0.5]).items()}
    long = quantiles.of_columns(df, list(middle))
    centre = F.create_map(*[x for c, m in middle.items() for x in (F.lit(c), F.lit(m))])[F.col("column")]
    mad = {c: v[0] for c, v in quantiles.exact(long.select("column", F.abs(F.col("x") - centre).alias("x")), [0.5]).items()}
    return df.sparkSession.createDataFrame([(c, middle[c], mad[c]) for c in middle], "column string, median double, mad double")


def extremes(cell: DataFrame, n: int = 3) -> DataFrame:
    """The n lowest and highest distinct numbers of each column."""
    x = cell.select("column", numeric.strict(F.col("raw")).alias("x")).where("x is not null").distinct()
    lo = F.row_number().over(Window.partitionBy("column").orderBy("x")).cast("bigint")
    hi = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("x"))).cast("bigint")
    low = x.withColumn("rank", lo).where(F.col("rank") <= n).withColumn("side", F.lit("low"))
    return low.unionByName(x.withColumn("rank", hi).where(F.col("rank") <= n).withColumn("side", F.lit("high")))


def exemplar_regex(value: str) -> str:
    """A pattern of a value's runs: digits and letters by class and length."""
    out = []
    for run in re.findall(r"[0-9]+|[A-Za-z]+|\s+|.", value):
        kind = r"\d" if run[0].isdigit() and run[0].isascii() else "[A-Za-z]" if run[0].isalpha() and run[0].isascii() else r"\s" if run[0].isspace() else None
        out.append(kind + ("{%d}" % len(run) if len(run) > 1 else "") if kind else re.escape(run))
    return "".join(out)


def regex_rates(cell: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """Share of each column's values that each pattern matches whole; one pass."""
    each = [F.struct(F.lit(p).alias("pattern"), ((F.col("column") == c) & text.full_match(F.trim("raw"), p)).alias("hit"), (F.col("column") == c).alias("own")) for c, ps in patterns.items() for p in ps]
    long = cell.where(F.col("raw").isNotNull()).select("column", F.explode(F.array(*each)).alias("e")).where("e.own")
    return long.groupBy("column", F.col("e.pattern").alias("pattern")).agg(F.count("*").alias("n"), F.avg(F.col("e.hit").cast("double")).alias("rate"))


def regex_candidates(cell: DataFrame, value: DataFrame, exemplars: int = 10, least: float = 0.5, n: int = 3) -> DataFrame:
    """Up to n patterns a column, made of its most frequent values, that hold for half."""
    tops = top_values(value, exemplars).select("column", "first_raw").collect()  # at most ten values a column
    patterns: dict[str, list[str]] = {}
    for r in tops:
        if r.first_raw and (p := exemplar_regex(r.first_raw.strip())) not in patterns.setdefault(r.column, []):
            patterns[r.column].append(p)
    return top(regex_rates(cell, patterns).where(F.col("rate") >= least).withColumnRenamed("n", "n_cells"), ["column"], n, ["pattern"], count="rate")


def coarse_types(cell: DataFrame) -> DataFrame:
    """numeric, categorical or text, from parse share, digits and distinctness."""
    raw = F.col("raw")
    s = cell.where(raw.isNotNull()).groupBy("column").agg(F.avg(numeric.strict(raw).isNotNull().cast("double")).alias("parsed"), F.avg(numeric.numeric_share(raw)).alias("digits"),
                                                         F.count_distinct("sig").alias("distinct"), F.count("*").alias("n"), F.avg(F.length(raw)).alias("length"))
    kind = F.when((F.col("parsed") >= 0.8) & (F.col("digits") >= 0.5), "numeric").when((F.col("distinct") / F.col("n") > 0.5) & (F.col("length") > 30), "text").otherwise("categorical")
    return s.withColumn("kind", kind)


def surfaces(cell: DataFrame) -> DataFrame:
    return cell.groupBy("column", text.surface(F.col("raw")).alias("surface")).agg(F.count("*").alias("n"))


def affixes(cell: DataFrame, width: int = 4, n: int = 10) -> DataFrame:
    """Most frequent first and last characters of each column's values."""
    t = F.lower(F.trim("raw"))
    each = cell.where(F.col("raw").isNotNull() & (F.length(t) >= width)).select("column", F.explode(F.array(
        F.struct(F.lit("prefix").alias("side"), F.substring(t, 1, width).alias("affix")), F.struct(F.lit("suffix").alias("side"), F.expr(f"right(lower(trim(raw)), {width})").alias("affix")))).alias("a")).select("column", "a.*")
    return top(each.groupBy("column", "side", "affix").agg(F.count("*").alias("n")), ["column", "side"], n, ["affix"])
