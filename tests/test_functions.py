import math

from pyspark.sql import functions as F

from veracell.functions import numeric, text


def column(spark, values, f):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


def test_signatures(spark):
    vals = [None, "  A  b ", "", "12-AB x.9", "N/A"]
    assert column(spark, vals, text.signature) == ["<na>", "a b", "<empty>", "12-ab x.9", "n/a"]
    assert column(spark, ["12-AB x.9"], text.shape) == ["DD-AASA.D"]
    assert column(spark, ["12-AB x.9"], text.profile_shape) == ["DD-AASA?D"]
    assert column(spark, ["123-AAB"], text.run_shape) == ["D-A"]
    assert column(spark, ["12-AB  c3", "é#", ""], text.grammar) == ["D2|<-:1>|A2|< :2>|M2", "X2", "<empty>"]


def test_surface(spark):
    assert column(spark, ["12%", "1.5", "3 cm", "New-York", "a1", "#"], text.surface) == ["numeric_percent_suffix", "plain_numeric", "numeric_with_suffix", "lexical", "mixed_alphanumeric", "other"]


def test_numbers(spark):
    assert column(spark, ["(12)", "$1,200.5", "12d", "", None, "5%"], numeric.strict) == [-12.0, 1200.5, None, None, None, 5.0]
    assert column(spark, ["about -7.5 m", "x"], numeric.lenient) == [-7.5, None]


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "abcx"), ("", "a")], "a string, b string")
    same, near, none = [r[0] for r in df.select(text.similarity(F.col("a"), F.col("b"))).collect()]
    assert same == 1.0 and none == 0.0
    assert math.isclose(near, 0.55 * 0.75 + 0.25 / 3)


def test_rarity(spark):
    df = spark.createDataFrame([(0.0,), (3.0,), (50.0,), (97.0,), (100.0,), (None,)], "x double")
    q = [F.lit(v) for v in (1.0, 5.0, 95.0, 99.0)]
    got = [r[0] for r in df.select(numeric.rarity(F.col("x"), *q)).collect()]
    assert got == [1.0, 0.9, 0.0, 0.9, 1.0, 0.0]
