from pyspark.sql import functions as F

from veracell.operators import relations as rel


def test_minority_value_disagrees_with_its_context(spark):
    rows = [(i, "1", c) for i, c in enumerate(["San Diego"] * 4 + ["San Diego CA"])] + [(5 + i, "2", "Austin") for i in range(3)]
    df = spark.createDataFrame(rows, "row_idx bigint, brewery_id string, city string")
    out = {(r.row_idx, r.tgt, r.polarity): r for r in rel.consensus(df, ["brewery_id", "city"], 8).collect()}
    hit = out[4, "city", "dirty"]
    assert (hit.ctx, hit.expected) == ("brewery_id", "san diego") and hit.strength > 0
    refs = [r.row_idx for r in rel.reference_rows(df, "brewery_id", "city").where("ctx_sig = '1'").orderBy("row_idx").collect()]
    assert refs == [0, 1, 2, 3]


def test_weak_majority_abstains(spark):
    df = spark.createDataFrame([(0, "1", "a"), (1, "1", "a"), (2, "1", "b")], "row_idx bigint, k string, v string")
    assert rel.consensus(df, ["k", "v"], 3).count() == 0


def test_tie_goes_to_the_value_seen_first(spark):
    df = spark.createDataFrame([(0, "A", "x"), (1, "A", "x"), (2, "A", "y"), (3, "A", "y")], "row_idx bigint, k string, v string")
    m = rel.modes(rel.pair_counts(df, ["k", "v"])).where("ctx = 'k'").first()
    assert m.mode_sig == "x" and m.mode_n == 2


def test_predictiveness_ends(spark):
    df = spark.range(40).select(F.col("id").alias("row_idx"), (F.col("id") % 4).cast("string").alias("a"), (F.col("id") % 2).cast("string").alias("b"), F.lit("c").alias("c"))
    p = {(r.ctx, r.tgt): r.predictiveness for r in rel.predictiveness(rel.pair_counts(df, ["a", "b", "c"])).collect()}
    assert abs(p["a", "b"] - 1) < 1e-9 and abs(p["b", "a"] - 0.5) < 1e-9 and p["a", "c"] == 0
