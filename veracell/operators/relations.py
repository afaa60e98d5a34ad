"""Dependencies between columns: pair histograms, predictiveness, consensus.

Histograms of all column pairs come from one aggregation over exploded pairs,
combined before its shuffle; all else works on those counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracell.functions import text

from .cells import FEW, spread

MIN_GROUP, MIN_SHARE, MIN_PREDICTIVE, MIN_MODE = 3, 0.80, 0.20, 3


def pair_counts(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """ctx, ctx_sig, tgt, tgt_sig, n, min_row for ordered pairs; missing contexts
    are left out. A row stands for ``weight`` rows, of which it is the first."""
    sig = {c: text.signature(F.col(f"`{c}`").cast("string")) for c in columns}
    wide = df.select("row_idx", (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"), *[s.alias(c) for c, s in sig.items()])
    pairs = [F.struct(F.lit(a).alias("ctx"), F.col(a).alias("ctx_sig"), F.lit(b).alias("tgt"), F.col(b).alias("tgt_sig")) for a in columns for b in columns if a != b]
    long = wide.select("row_idx", "_w", F.explode(F.array(*pairs)).alias("p")).select("row_idx", "_w", "p.*")
    long = long.where(~F.col("ctx_sig").isin("<na>", "<empty>", *[m for m in text.RULE_MISSING if m]))
    return long.groupBy("ctx", "ctx_sig", "tgt", "tgt_sig").agg(F.sum("_w").alias("n"), F.min("row_idx").alias("min_row"))


def predictiveness(counts: DataFrame) -> DataFrame:
    """1 - H(target | context) / H(target) of each ordered pair, in [0, 1]."""
    group = counts.groupBy("ctx", "tgt", "ctx_sig").agg(F.sum("n").alias("g"), F.sum(F.col("n") * F.log("n")).alias("s"))
    within = group.groupBy("ctx", "tgt").agg(F.sum("g").alias("total"), F.sum(F.col("g") * F.log("g") - F.col("s")).alias("h_within"))
    target = counts.groupBy("ctx", "tgt", "tgt_sig").agg(F.sum("n").alias("t"))
    overall = target.groupBy("ctx", "tgt").agg(F.sum("t").alias("all"), F.sum(F.col("t") * F.log("t")).alias("s"))
    h = F.col("all") * F.log("all") - F.col("s")
    out = within.join(overall, ["ctx", "tgt"])
    value = F.when(h <= 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("h_within") / h)))
    return out.select("ctx", "tgt", value.alias("predictiveness"))


def modes(counts: DataFrame) -> DataFrame:
    """Each context group's most frequent target; first seen wins a tie."""
    group = counts.groupBy("ctx", "tgt", "ctx_sig").agg(
        F.sum("n").alias("g"), F.max_by("tgt_sig", F.struct("n", -F.col("min_row"))).alias("mode_sig"), F.max("n").alias("mode_n"), F.count("*").alias("n_targets"))
    return group


FD_GROUP, FD_MODE, FD_SHARE = 3, 2, 0.50


def consensus(df: DataFrame, columns: list[str], n_rows: int, identifiers: frozenset[str] = frozenset(),
              dependencies: frozenset[tuple[str, str]] = frozenset()) -> DataFrame:
    """The best dis/agreement of each cell with its context groups: row_idx, tgt,
    polarity, ctx, expected, strength, rule.

    What a group says of a value is settled once for each distinct pair of
    signatures, and what is best once for each distinct combination of values, of
    which the first row stands for all. Columns of ``identifiers``
    agree on weaker support, and so do disagreements under an accepted dependency
    (determinant, dependent), which have ``rule`` set. Missing cells are left out.
    """
    own = [f"_v{k}" for k in range(len(columns))]
    rows = df.select("row_idx", *[F.col(f"`{c}`").cast("string").alias(v) for c, v in zip(columns, own)])
    each = rows.groupBy(*own).agg(F.count("*").alias("_n"), F.min("row_idx").alias("row_idx")).persist()
    distinct = each.withColumnsRenamed(dict(zip(own, columns)))
    counts = pair_counts(distinct, columns, "_n")
    known = predictiveness(counts).where(F.col("predictiveness") >= MIN_PREDICTIVE)
    groups = modes(counts).where(F.col("g") >= MIN_GROUP).join(F.broadcast(known), ["ctx", "tgt"])  # a row a column pair
    p, share = F.col("n") / F.col("g"), F.col("mode_n") / F.col("g")
    sound = (F.col("mode_n") >= MIN_MODE) & (share >= MIN_SHARE)
    named = F.lit(False)
    for left, right in sorted(dependencies):
        named = named | ((F.col("ctx") == left) & (F.col("tgt") == right))
    rule = named & (F.col("mode_n") >= FD_MODE) & (F.col("mode_n") > F.col("n")) & (share >= FD_SHARE)
    agrees = F.col("tgt_sig") == F.col("mode_sig")
    ok = F.when(agrees, sound | F.col("tgt").isin(*identifiers)).otherwise(sound | rule)
    base = F.least(F.lit(1.0), F.col("predictiveness") * F.log(F.col("g").cast("double")) / F.log(F.lit(float(1 + max(n_rows, 2)))))
    said = counts.join(groups, ["ctx", "tgt", "ctx_sig"]).where(ok & ~F.col("tgt_sig").isin("<na>", "<empty>", *[m for m in text.RULE_MISSING if m])).select(
        "ctx", "ctx_sig", "tgt", "tgt_sig", F.when(agrees, "clean").otherwise("dirty").alias("polarity"), F.col("mode_sig").alias("expected"),
        (base * F.when(agrees, p).otherwise(1 - p)).alias("strength"), (~agrees & rule & ~sound).alias("rule"), "n")
    sig = {c: text.signature(F.col(f"`{c}`").cast("string")) for c in columns}
    pairs = [F.struct(F.lit(a).alias("ctx"), sig[a].alias("ctx_sig"), F.lit(b).alias("tgt"), sig[b].alias("tgt_sig")) for a in columns for b in columns if a != b]
    few = lambda found: found.limit(FEW + 1).count() <= FEW
    met = spread(distinct.select("row_idx", F.explode(F.array(*pairs)).alias("p")).select("row_idx", "p.*"), said, ["ctx", "ctx_sig", "tgt", "tgt_sig"], few(said))
    first = F.create_map(*[x for k, c in enumerate(columns) for x in (F.lit(c), F.lit(-k))])[F.col("ctx")]
    best = F.max_by(F.struct("ctx", "expected", "strength", "rule"), F.struct(F.round("strength", 12), first))
    found = met.groupBy("row_idx", "tgt", "polarity").agg(best.alias("b")).join(each, "row_idx").select(*own, "_n", "tgt", "polarity", "b.*")
    return spread(rows, found, own, few(each), "_n").select("row_idx", "tgt", "polarity", "ctx", "expected", "strength", "rule")


def reference_rows(df: DataFrame, ctx: str, tgt: str, most: int = 5) -> DataFrame:
    """For each reliable group, the first rows that have its most frequent target."""
    counts = pair_counts(df, [ctx, tgt]).where((F.col("ctx") == ctx) & (F.col("tgt") == tgt))
    groups = modes(counts).where((F.col("g") >= MIN_GROUP) & (F.col("mode_n") >= MIN_MODE) & (F.col("mode_n") / F.col("g") >= MIN_SHARE))
    rows = df.select("row_idx", text.signature(F.col(ctx).cast("string")).alias("ctx_sig"), text.signature(F.col(tgt).cast("string")).alias("mode_sig"))
    rank = F.row_number().over(Window.partitionBy("ctx_sig").orderBy("row_idx")).cast("bigint")
    return rows.join(groups.select("ctx_sig", "mode_sig"), ["ctx_sig", "mode_sig"]).withColumn("rank", rank).where(F.col("rank") <= most)


def dependencies(df: DataFrame, pairs: list[tuple[str, str]], least_rows: int = 50, least_share: float = 0.90) -> DataFrame:
    """Key columns whose groups nearly all have one value of the other column."""
    structs = [F.struct(F.lit(a).alias("k"), F.col(a).cast("string").alias("kv"), F.lit(b).alias("d"), F.col(b).cast("string").alias("dv")) for a, b in pairs]
    long = df.select(F.explode(F.array(*structs)).alias("p")).select("p.*").where("kv is not null and dv is not null")
    per = long.groupBy("k", "d", "kv", "dv").agg(F.count("*").alias("n")).groupBy("k", "d", "kv").agg(F.count("*").alias("n_values"), F.sum("n").alias("n"))
    out = per.groupBy("k", "d").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.avg((F.col("n_values") == 1).cast("double")).alias("single_share"))
    return out.withColumn("accepted", (F.col("n_rows") >= least_rows) & (F.col("single_share") >= least_share))


def relation_profile(df: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    """How often a relation applies and fails."""
    va, vb = F.col(a).cast("string"), F.col(b).cast("string")
    applies = ~text.missing_like(va) & ~text.missing_like(vb)
    bad = applies & ~text.relation_holds(kind, va, vb)
    return df.agg(F.count_if(applies).alias("n_applicable"), F.count_if(bad).alias("n_violations")).select(
        F.lit(kind).alias("kind"), "n_applicable", "n_violations", (F.col("n_violations") / F.col("n_applicable")).alias("violation_rate"))


def cooccurrence(df: DataFrame, a: str, b: str, n: int = 15) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(n)
