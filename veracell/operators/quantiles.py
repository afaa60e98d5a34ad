"""Exact percentiles of any number of rows.

The built-in exact percentile holds a group's distinct values in one task. Here
a first scan finds approximate percentiles, whose error is bounded, and so a
bracket of values for each asked-for rank. A second scan counts the values
inside brackets and, between them, rows only. The counts are sorted on the driver
if they are few; else put into buckets between approximate pivots, of which only
those that hold an asked-for rank are sorted, each in a task of its own. The driver
gets a row for each column and bucket, and two for each answer.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 128
#: Approximate ranks are off by a share of 1 / ACCURACY at most; brackets reach twice as far.
ACCURACY = 10_000
#: Distinct (column, value) rows up to which counts are sorted on the driver.
FEW = 1 << 20


def interpolated(at, n: int, ps: list[float]) -> list[float]:
    """Percentiles from a function of rank."""
    out = []
    for p in ps:
        h = p * (n - 1)
        lo, hi = at(math.floor(h)), at(math.ceil(h))
        out.append(lo + (hi - lo) * (h - math.floor(h)))
    return out


def sorted_here(counts: pd.DataFrame, ps: list[float]) -> dict[str, list[float]]:
    """The same from a number of counts that is known to be small."""
    out = {}
    for c, g in counts.groupby("column"):
        g = g.sort_values("x")
        x, upto = g.x.to_numpy(), g.n.cumsum().to_numpy()
        out[c] = interpolated(lambda r, x=x, upto=upto: float(x[upto.searchsorted(r, side="right")]), int(upto[-1]), ps)
    return out


def bracketed(known: DataFrame, ps: list[float]) -> Column:
    """x where it is in a bracket of its column; the rows of a gap between brackets
    have one number that stands in their place. Short columns are one bracket."""
    x, reach = F.col("x"), 2 / ACCURACY
    edges = [e for p in ps for e in (max(0.0, p - reach), min(1.0, p + reach))]
    rows = known.groupBy("column").agg(F.count("*").alias("n"), F.percentile_approx("x", F.array(*map(F.lit, edges)), F.lit(ACCURACY)).alias("q")).collect()  # a row a column
    out = x
    for r in rows:
        if r.n <= 4 * ACCURACY:
            continue
        ends = [-math.inf if e == 0 else math.inf if e == 1 else v for e, v in zip(edges, r.q)]
        held: list[list[float]] = []
        for lo, hi in sorted(zip(ends[::2], ends[1::2])):
            if held and lo <= held[-1][1]:
                held[-1][1] = max(held[-1][1], hi)
            else:
                held.append([lo, hi])
        own = F.lit(math.nextafter(held[-1][1], math.inf))
        for lo, hi in reversed(held):
            own = F.when(x < lo, F.lit(math.nextafter(lo, -math.inf))).when(x <= hi, x).otherwise(own)
        out = F.when(F.col("column") == r.column, own).otherwise(out)
    return out


def exact(long: DataFrame, ps: list[float], buckets: int = BUCKETS, few: int = FEW) -> dict[str, list[float]]:
    """Linearly interpolated percentiles of (column, x) by column; nulls and not-
    a-numbers are left out, a column without numbers is missing from the result.
    A row with ``n`` stands for so many."""
    x = F.col("x")
    known = long.where(x.isNotNull() & ~F.isnan(x))
    if "n" in long.columns:
        counts = known.groupBy("column", "x").agg(F.sum("n").alias("n"))
    else:
        counts = known.select("column", bracketed(known, ps).alias("x")).groupBy("column", "x").agg(F.count("*").alias("n"))
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        small = counts.limit(few + 1).toPandas()
        if len(small) <= few:
            return sorted_here(small, ps)
        steps = [F.lit(k / buckets) for k in range(1, buckets)]
        pivots = {r.column: sorted(set(r.p)) for r in counts.groupBy("column").agg(F.percentile_approx("x", F.array(*steps), 4096).alias("p")).collect()}
        if not pivots:
            return {}
        bucket = None
        for c, p in pivots.items():
            own = F.size(F.filter(F.array(*map(F.lit, p)), lambda v: v <= x))
            bucket = F.when(F.col("column") == c, own) if bucket is None else bucket.when(F.col("column") == c, own)
        placed = counts.withColumn("bucket", bucket)
        totals: dict[str, list[int]] = {c: [0] * (len(p) + 1) for c, p in pivots.items()}
        for r in placed.groupBy("column", "bucket").agg(F.sum("n").alias("n")).collect():
            totals[r.column][r.bucket] = r.n
        asked = []  # (column, bucket, rank within the bucket, rank)
        for c, ns in totals.items():
            before = [0, *accumulate(ns)]
            for rank in sorted({f(p * (before[-1] - 1)) for p in ps for f in (math.floor, math.ceil)}):
                b = bisect_right(before, rank) - 1
                asked.append((c, b, rank - before[b], rank))
        spark = long.sparkSession
        wanted = F.broadcast(spark.createDataFrame(asked, "column string, bucket int, local bigint, rank bigint"))
        held = placed.join(wanted.select("column", "bucket").distinct(), ["column", "bucket"], "left_semi")
        upto = F.sum("n").over(Window.partitionBy("column", "bucket").orderBy("x"))
        met = held.withColumn("upto", upto).join(wanted, ["column", "bucket"]).where((F.col("local") < F.col("upto")) & (F.col("local") >= F.col("upto") - F.col("n")))
        at = {(r.column, r["rank"]): r.x for r in met.select("column", "rank", "x").collect()}
    finally:
        counts.unpersist()
    return {c: interpolated(lambda r, c=c: at[c, r], sum(ns), ps) for c, ns in totals.items()}


def of_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x) of several columns of a table."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns]))
    return df.select(each.alias("e")).select("e.*")
