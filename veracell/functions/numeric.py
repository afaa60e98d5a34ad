"""Number parsing, robust statistics and strengths, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def guarded(text: Column) -> Column:
    """A double, or null where the text isn't a plain number: a bare cast would
    read 12d as 12."""
    return F.when(text.rlike(NUMBER), F.expr("1").cast("double") * text.try_cast("double"))


def strict(v: Column) -> Column:
    """``(x)`` is negative; percent and dollar signs and commas are dropped."""
    t = F.trim(v.cast("string"))
    t = F.when(t.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_extract(t, r"^\((.*)\)$", 1))).otherwise(t)
    return guarded(F.trim(F.regexp_replace(t, "[%$,]", "")))


def lenient(v: Column) -> Column:
    """The first number anywhere in the value."""
    return guarded(F.regexp_extract(v.cast("string"), r"(-?\d+(\.\d+)?)", 1))


def contract(v: Column, matches: Column) -> Column:
    """Strict; else the first number where the column's pattern holds."""
    return F.coalesce(strict(v), F.when(matches, lenient(v)))


def safe_float(v: Column) -> Column:
    return guarded(F.trim(F.regexp_replace(v.cast("string"), ",", "")))


def numeric_share(v: Column) -> Column:
    t = F.regexp_replace(v.cast("string"), r"\s", "")
    return F.when(F.length(t) > 0, F.length(F.regexp_replace(t, "[^0-9]", "")) / F.length(t)).otherwise(0.0)


def clip(p: Column, low: float = 1e-4, high: float = 1 - 1e-4) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), p))


def logit(p: Column) -> Column:
    q = clip(p)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def certainty(p: Column) -> Column:
    """1 minus the binary entropy in bits."""
    q = clip(p, 1e-6, 1 - 1e-6)
    return 1 + (q * F.log(q) + (1 - q) * F.log(1 - q)) / F.log(F.lit(2.0))


def rarity(x: Column, p01: Column, p05: Column, p95: Column, p99: Column) -> Column:
    """1 outside the outer percentiles, a ramp between outer and inner ones."""
    ramp = lambda over, width: F.least(F.lit(1.0), 0.4 + over / F.greatest(width, F.lit(1e-6)))
    return (F.when(x.isNull() | p05.isNull() | p95.isNull(), 0.0).when((x < p01) | (x > p99), 1.0)
            .when(x < p05, ramp(p05 - x, p05 - p01)).when(x > p95, ramp(x - p95, p99 - p95)).otherwise(0.0))


def low_frequency(support: Column, listed: Column | None = None) -> Column:
    out = F.when(support <= 1, 0.80).when(support == 2, 0.65).when(support == 3, 0.50).otherwise(0.0)
    return out if listed is None else F.when(listed, 0.85).otherwise(out)


def robust_z(x: Column, median: Column, mad: Column) -> Column:
    """Distance from the median in MADs, an eighth of it at most 1."""
    return F.least(F.lit(1.0), F.abs(x - median) / F.greatest(mad, F.lit(1e-9)) / 8)


def hash_bucket(v: Column, n: int | Column) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(F.conv(F.substring(F.md5(v.cast("string")), 1, 8), 16, 10).cast("bigint"), n)


def modulo_share(x: Column, n: int) -> Column:
    return F.pmod(x, F.lit(n)) / n
