"""Queries of semantics, annotations and event windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracell.operators import annotations as an
from veracell.operators import cells as ce
from veracell.operators import profile as pr
from veracell.operators import semantics as se
from veracell.streaming import score

from .catalogue import CUSTOMER_COLUMNS, CUSTOMER_SQL, PAIRS, cells_sql, query, table
from .catalogue2 import BUCKET, CLEAN, DIRTY, ORDER_RULES, RULE_SQL, _orders
from .inputs import dirty_customer, dirty_part
from veracell.operators import dual as du
from veracell.operators import rules as ru

ARCHETYPES = {"c_mktsegment": "closed_enum", "nationkey": "identifier", "nation": "closed_enum", "region": "closed_enum"}


@query(PAIRS + """, k AS (SELECT * FROM cnt WHERE tgt_sig NOT IN ('<na>', '<empty>')), m AS (SELECT ctx, tgt, ctx_sig, sum(n) AS g, max(n) AS mode_n FROM k GROUP BY 1, 2, 3),
 s AS (SELECT ctx, tgt, count(*) AS n_groups, median(g) AS median_size, CAST(max(g) AS BIGINT) AS max_size, median(mode_n / g) AS median_share FROM m WHERE g >= 3 GROUP BY 1, 2),
 kg AS (SELECT ctx, tgt, ctx_sig, sum(n) AS g, sum(n * ln(n)) AS s FROM k GROUP BY 1, 2, 3), kw AS (SELECT ctx, tgt, sum(g * ln(g) - s) AS hw FROM kg GROUP BY 1, 2), kt AS (SELECT ctx, tgt, tgt_sig, sum(n) AS t FROM k GROUP BY 1, 2, 3),
 ko AS (SELECT ctx, tgt, sum(t) * ln(sum(t)) - sum(t * ln(t)) AS h FROM kt GROUP BY 1, 2), kp AS (SELECT ctx, tgt, CASE WHEN h <= 1e-12 THEN 0 ELSE greatest(0, least(1, 1 - hw / h)) END AS predictiveness FROM kw JOIN ko USING (ctx, tgt)),
 r AS (SELECT s.*, predictiveness, row_number() OVER (PARTITION BY ctx ORDER BY round(predictiveness, 4) DESC, max_size DESC, tgt) AS turn FROM s JOIN kp USING (ctx, tgt))
 SELECT ctx, tgt, n_groups, median_size, max_size, round(median_share, 6) AS median_share, round(predictiveness, 6) AS predictiveness, turn FROM r ORDER BY turn, ctx LIMIT 24""")
def dependency_candidates(spark, d):
    out = se.dependency_candidates(dirty_customer(spark, d), ARCHETYPES)
    return out.select("ctx", "tgt", "n_groups", "median_size", "max_size", F.round("median_share", 6).alias("median_share"), F.round("predictiveness", 6).alias("predictiveness"), "turn")


@query(PAIRS + """, m AS (SELECT ctx_sig, sum(n) AS g, max(n) AS mode_n FROM cnt WHERE ctx = 'nationkey' AND tgt = 'nation' GROUP BY 1),
 ms AS (SELECT ctx_sig, tgt_sig AS mode_sig FROM (SELECT *, row_number() OVER (PARTITION BY ctx_sig ORDER BY n DESC, min_row) AS r FROM cnt WHERE ctx = 'nationkey' AND tgt = 'nation') WHERE r = 1)
 SELECT p.row_idx, 'nation' AS tgt, 'dirty' AS polarity, 'nationkey' AS ctx, mode_sig AS expected, round(least(1.0, predictiveness * ln(g) / ln(1 + greatest((SELECT count(*) FROM src), 2))) * (1 - n / g), 6) AS strength
 FROM pair p JOIN m USING (ctx_sig) JOIN ms USING (ctx_sig) JOIN cnt c ON c.ctx = p.ctx AND c.tgt = p.tgt AND c.ctx_sig = p.ctx_sig AND c.tgt_sig = p.tgt_sig JOIN pred ON pred.ctx = p.ctx AND pred.tgt = p.tgt
 WHERE p.ctx = 'nationkey' AND p.tgt = 'nation' AND g >= 3 AND mode_n >= 2 AND mode_n / g >= 0.5 AND p.tgt_sig <> mode_sig AND mode_n > n""")
def dependency_disagreement(spark, d):
    return se.dependency_disagreement(dirty_customer(spark, d), "nationkey", "nation").withColumn("strength", F.round("strength", 6))


PROFILED = ["c_name", "c_mktsegment", "nationkey", "nation", "region"]


@query(cells_sql(PROFILED, CUSTOMER_SQL) + """, v AS (SELECT col, sig, count(*) AS n FROM cell WHERE sig <> '<na>' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, sig) AS k FROM v),
 s AS (SELECT col, count(*) / sum(n) AS unique_ratio, sum(n) FILTER (k <= 10) / sum(n) AS top_coverage FROM r GROUP BY 1)
 SELECT col AS "column", round(unique_ratio, 9) AS unique_ratio, round(top_coverage, 9) AS top_coverage, CASE WHEN col = 'region' THEN 'geo_name' WHEN col = 'c_name' OR unique_ratio >= 0.5 THEN 'open_entity'
  WHEN unique_ratio <= 0.10 AND top_coverage >= 0.30 THEN 'closed_enum' ELSE 'free_text' END AS archetype FROM s""")
def column_archetypes(spark, d):
    """Archetypes from names and from how the columns' values are spread."""
    spread = pr.uniqueness(ce.values(ce.cells(dirty_customer(spark, d), PROFILED))).collect()  # a row a column
    rows = [(r.column, round(r.unique_ratio, 9), round(r.top10_coverage, 9), se.archetype(r.column, "text", r.unique_ratio, r.top10_coverage).archetype) for r in spread]
    return spark.createDataFrame(rows, "column string, unique_ratio double, top_coverage double, archetype string")


@query()
def pattern_exploration(spark, d):
    """Patterns of a dirty column with their coverage (rows only: rounds of search)."""
    return spark.createDataFrame(se.explore_patterns(dirty_part(spark, d), "p_brand"), "pattern string, coverage double")


_HITS = " UNION ALL ".join(f"SELECT o_orderkey AS row_idx, '{r.column}' AS col, '{r.name}' AS rule FROM orders WHERE NOT ({s})" for r, s in zip(ORDER_RULES, RULE_SQL))
_RATES = " UNION ALL ".join(f"SELECT '{r.name}' AS rule, count(*) FILTER (NOT ({s})) / count(*) AS rate FROM orders" for r, s in zip(ORDER_RULES, RULE_SQL))


@query(f"""WITH h AS ({_HITS}), t AS ({_RATES}), r AS (SELECT row_idx, col, rule, rate, row_number() OVER (PARTITION BY row_idx, col ORDER BY rate, rule) AS k FROM h JOIN t USING (rule))
 SELECT row_idx, col AS "column", rule, round(rate, 9) AS rate FROM r WHERE k = 1""")
def weakest_violated_rule(spark, d):
    o = _orders(spark, d)
    flat = ru.outputs(o, ORDER_RULES)
    each = F.explode(F.array(*[F.struct(F.lit(r.column).alias("column"), F.lit(r.name).alias("rule"), F.col(r.name).alias("ok")) for r in ORDER_RULES]))
    hits = flat.select("row_idx", each.alias("e")).select("row_idx", "e.*").where("not ok")
    rates = ru.violation_rates(o, ORDER_RULES).select("rule", "rate")
    return an.weakest_rule(hits.join(F.broadcast(rates), "rule")).withColumn("rate", F.round("rate", 9))


@query("""WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 200000 OR o_orderstatus = 'P'), b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority LIKE '1%')
 SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS tp, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS fp, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS fn""")
def found_and_true_sets(spark, d):
    o = _orders(spark, d)
    return an.set_counts(du.errors(o, DIRTY, CLEAN, "or_only"), o.where(F.col("o_orderpriority").startswith("1")), ["row_idx"])


@query("SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM orders GROUP BY 1, 2")
def result_grid(spark, d):
    return an.grid(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """An extension: tumbling windows with a watermark, here over a finished table."""
    e = table(spark, d, "events").select("ts", "event_type", "value")
    return score.event_windows(e).withColumn("total", F.round("total", 6))


_BLANK = "[\'\', \'n/a\', \'null\'][" + BUCKET.format("clean", "3") + " + 1]"


@query(f"""WITH p AS (SELECT DISTINCT CAST(p_type AS VARCHAR) AS clean FROM part UNION SELECT DISTINCT CAST(p_size AS VARCHAR) FROM part),
 e AS (SELECT clean, {_BLANK} AS wrong, 'missing' AS family FROM p UNION ALL SELECT clean, clean || '#?', 'pattern' FROM p
  UNION ALL SELECT clean, CASE WHEN regexp_full_match(clean, '-?[0-9]+') THEN CAST(CAST(clean AS DOUBLE) * 1000 AS VARCHAR) ELSE repeat(clean, 3) END, 'outlier' FROM p
  UNION ALL SELECT clean, lead(clean) OVER (PARTITION BY {BUCKET.format("clean", "64")} ORDER BY clean), 'relationship' FROM p) SELECT * FROM e WHERE wrong IS NOT NULL AND wrong <> clean""")
def made_errors(spark, d):
    """Wrong values of all four families from the types and sizes of parts."""
    p = table(spark, d, "part")
    seeds = p.select("p_type").unionByName(p.select(F.col("p_size").cast("string").alias("p_type"))).distinct()
    families = [an.made_errors(seeds, "p_type", f) for f in ("missing", "pattern", "outlier", "relationship")]
    return reduce(DataFrame.unionByName, families)


@query()
def likely_typos(spark, d):
    """Brands that nearly match the right one by matching blocks (rows only: no SQL for it)."""
    p = dirty_part(spark, d).where("p_brand is not null").select("p_brand", "clean_brand").distinct()
    return p.where(an.looks_like_typo(F.col("p_brand"), F.col("clean_brand")))


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_ROW = "concat_ws(chr(31), " + ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '-')" for c in [*_PART, "p_partkey"]) + ")"
_SCHEMA = "struct<p_partkey:bigint,p_name:string,p_brand:string,p_type:string,p_size:int,p_retailprice:double,row_idx:bigint>"


@query(f"""WITH h AS (SELECT ('0x' || substr(md5({_ROW}), 1, 15))::BIGINT AS h FROM part), a AS (SELECT count(*) AS n, bit_xor(h) AS x, sum(h) AS s FROM h)
 SELECT n, sha256('{_SCHEMA}|' || n || '|' || x || '|' || s) AS sha256 FROM a""")
def table_fingerprint(spark, d):
    """Count and hash over all rows, columns and the order of the table."""
    return ce.fingerprint(ce.with_rows(table(spark, d, "part").select(*_PART), "p_partkey"))
