"""Detection against a reference table, explanations against their model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracell.functions import numeric, text


def truth(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """row_idx, column, dirty, clean, label: 1 where the cell differs, both
    missing being equal. ``pairs`` maps a column to its clean twin."""
    each = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("dirty"), F.col(f"`{k}`").cast("string").alias("clean")) for c, k in pairs.items()]
    d = df.select("row_idx", F.explode(F.array(*each)).alias("p")).select("row_idx", "p.*")
    a, b = F.col("dirty"), F.col("clean")
    same = a.eqNullSafe(b) | (text.missing_like(a) & text.missing_like(b))
    return d.withColumn("label", F.when(same, 0).otherwise(1))


def metrics(flags: DataFrame, by: str | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of (predicted, label); with ``by`` also
    for each group, the whole under null, in one rollup."""
    p, y = F.col("predicted") == 1, F.col("label") == 1
    aggs = [F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn")]
    g = flags.rollup(by).agg(*aggs) if by else flags.agg(*aggs)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return g.withColumn("precision", safe(tp, tp + fp)).withColumn("recall", safe(tp, tp + fn)).withColumn("f1", safe(2 * tp, 2 * tp + fp + fn))


def error_type(dirty: Column, clean: Column) -> Column:
    return F.when(text.missing_like(dirty), "missing_value").when(text.shape(dirty) != text.shape(clean), "pattern_violation").otherwise("rule_violation")


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def threshold_sweep(scored: DataFrame, steps: int = 99) -> DataFrame:
    """tp, fp, fn, f1 at thresholds k / (steps + 1), from one histogram of scores."""
    # the bin of a score is the number of thresholds it reaches; a row a bin remains
    bins = scored.groupBy(F.floor(F.col("score") * (steps + 1) + 1e-9).cast("int").alias("bin")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    t = scored.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("k"))
    both = t.join(F.broadcast(bins), F.lit(True), "left").groupBy("k").agg(
        F.sum(F.when(F.col("bin") >= F.col("k"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("bin") >= F.col("k"), F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("bin") < F.col("k"), F.col("pos")).otherwise(0)).alias("fn"))
    return both.select((F.col("k") / (steps + 1)).alias("threshold"), "tp", "fp", "fn", F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0).alias("f1"))


def faithfulness(contrib: DataFrame, k: int = 3, threshold: float = 0.5) -> DataFrame:
    """Of each dirty cell: how far the score falls without its k best reasons
    (comprehensiveness), how near it stays with them alone (sufficiency), and
    whether the decision flips."""
    rank = F.row_number().over(Window.partitionBy("row_idx", "column").orderBy(F.desc("w"), "source", "scope"))
    c = contrib.where(F.col("posterior") >= threshold).withColumn("r", rank)
    g = c.groupBy("row_idx", "column").agg(F.first("posterior").alias("posterior"), F.first("logit").alias("logit"), F.sum(F.when((F.col("r") <= k) & (F.col("w") > 0), F.col("w")).otherwise(0)).alias("best"), F.sum("w").alias("total"))
    without = numeric.sigmoid(F.col("logit") - F.col("best"))
    alone = numeric.sigmoid(F.col("logit") - F.col("total") + F.col("best"))
    return g.select("row_idx", "column", (F.col("posterior") - without).alias("comprehensiveness"), (F.col("posterior") - alone).alias("sufficiency"), (without < threshold).alias("flips"))


def key_check(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that repeat in either table or are in only one; empty if all align."""
    x = a.groupBy(key).agg(F.count("*").alias("n_left"))
    y = b.groupBy(key).agg(F.count("*").alias("n_right"))
    j = x.join(y, key, "full_outer").na.fill(0, ["n_left", "n_right"])
    return j.where((F.col("n_left") != 1) | (F.col("n_right") != 1))


def column_errors(truths: DataFrame, n: int = 5) -> DataFrame:
    """column, error type, number, share of the column's rows and the first examples."""
    total = truths.groupBy("column").agg(F.count("*").alias("n_rows"))
    wrong = truths.where("label = 1").withColumn("error_type", error_type(F.col("dirty"), F.col("clean")))
    shown = F.concat(F.coalesce("dirty", F.lit("(null)")), F.lit(" -> "), F.coalesce("clean", F.lit("(null)")))
    rank = F.row_number().over(Window.partitionBy("column", "error_type").orderBy("row_idx"))
    first = wrong.select("column", "error_type", "row_idx", shown.alias("shown")).withColumn("r", rank).where(F.col("r") <= n)
    examples = first.groupBy("column", "error_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "shown"))), lambda e: e["shown"]), "; ").alias("examples"))
    counts = wrong.groupBy("column", "error_type").agg(F.count("*").alias("n")).join(F.broadcast(total), "column")  # a row a column
    return counts.join(examples, ["column", "error_type"]).select("column", "error_type", "n", (F.col("n") / F.col("n_rows")).alias("rate"), "examples")


def typed_metrics(flags: DataFrame) -> DataFrame:
    """Recall of each error type, and over all the share of dirty cells whose
    proposed repair is right; of (predicted, label, dirty, clean, repair)."""
    wrong = flags.where("label = 1").withColumn("error_type", error_type(F.col("dirty"), F.col("clean")))
    right = F.col("repair").eqNullSafe(F.col("clean"))
    return wrong.rollup("error_type").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == 1).alias("found"), F.count("repair").alias("n_repairs"), F.count_if(F.col("repair").isNotNull() & right).alias("n_right")).select(
        F.coalesce("error_type", F.lit("<all>")).alias("error_type"), "n", "found", (F.col("found") / F.col("n")).alias("recall"), "n_repairs", "n_right",
        F.when(F.col("n_repairs") > 0, F.col("n_right") / F.col("n_repairs")).otherwise(0.0).alias("repair_accuracy"))


def preparation(dirty: DataFrame, clean: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: rows of both tables that share a key, cells compared, cells that differ."""
    a = dirty.select(key, *[F.col(c).cast("string").alias(f"a_{k}") for k, c in enumerate(columns)])
    b = clean.select(key, *[F.col(c).cast("string").alias(f"b_{k}") for k, c in enumerate(columns)])
    differ = sum((F.when(F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")), 0).otherwise(1) for k in range(len(columns))), F.lit(0))
    return a.join(b, key).agg(F.count("*").alias("n_rows"), (F.count("*") * len(columns)).alias("n_cells"), F.sum(differ).alias("n_differing"))
