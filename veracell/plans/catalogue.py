"""Queries over the star schema, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from veracell.functions import numeric, text
from veracell.operators import cells as ce
from veracell.operators import profile as pr
from veracell.operators import relations as re_

from .inputs import CUSTOMER_SQL, PART_SQL, dirty_customer, dirty_part, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

PART_COLUMNS = ["p_name", "p_brand", "p_type", "p_size"]
CUSTOMER_COLUMNS = ["c_mktsegment", "nationkey", "nation", "region"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _list(tokens) -> str:
    return ", ".join(f"'{t}'" for t in tokens)


COLLAPSED = "regexp_replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), '\\s+', ' ', 'g')"
SIG = f"CASE WHEN {{0}} IS NULL THEN '<na>' WHEN {COLLAPSED} = '' THEN '<empty>' ELSE {COLLAPSED} END"
SHAPE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '[0-9]', chr(1), 'g'), '[A-Za-z]', 'A', 'g'), '\\s', 'S', 'g'), chr(1), 'D', 'g')"


def cells_sql(columns: list[str], source: str) -> str:
    """CTEs src and cell for an unpivoted table."""
    each = " UNION ALL ".join(f"SELECT row_idx, '{c}' AS col, CAST({c} AS VARCHAR) AS raw FROM src" for c in columns)
    return f"WITH src AS ({source}), cell0 AS ({each}), cell AS (SELECT *, {SIG.format('raw')} AS sig FROM cell0)"


PART_CELLS = cells_sql(PART_COLUMNS, PART_SQL)
VALUES = PART_CELLS + ', val AS (SELECT col, sig, count(*) AS support, min(row_idx) AS first_row, arg_min(raw, row_idx) AS first_raw FROM cell GROUP BY 1, 2)'


def part_cells(spark, d):
    return ce.cells(dirty_part(spark, d), PART_COLUMNS)


@query(PART_CELLS + f""" SELECT col AS "column", count(*) AS n_rows, count(*) FILTER (raw IS NULL) AS n_null,
  count(*) FILTER (raw IS NULL OR {COLLAPSED.format('raw')} IN ({_list(text.PROFILE_MISSING)})) AS n_missing FROM cell GROUP BY 1""")
def null_profile(spark, d):
    return pr.null_counts(part_cells(spark, d))


@query(PART_CELLS + f""", c AS (SELECT col, {COLLAPSED.format('raw')} AS token, count(*) AS n FROM cell WHERE raw IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, token) AS rank FROM c WHERE token IN ({_list(text.PROFILE_MISSING)}))
 SELECT col AS "column", token, n, rank FROM r WHERE rank <= 10""")
def missing_token_profile(spark, d):
    return pr.missing_tokens(part_cells(spark, d))


@query(VALUES + ' SELECT col AS "column", sig, support, first_row, coalesce(first_raw, \'<null>\') AS first_raw FROM val')
def value_registry(spark, d):
    return ce.values(part_cells(spark, d)).withColumn("first_raw", F.coalesce("first_raw", F.lit("<null>")))


@query(PART_CELLS + ' SELECT col AS "column", count(*) AS n_cells, count(DISTINCT row_idx) AS n_rows, count(DISTINCT sig) AS n_values FROM cell GROUP BY 1')
def cell_registry_counts(spark, d):
    c = part_cells(spark, d)
    return c.groupBy("column", "sig").agg(F.count("*").alias("n")).groupBy("column").agg(F.sum("n").alias("n_cells"), F.sum("n").alias("n_rows"), F.count("*").alias("n_values"))


@query(VALUES + """, t AS (SELECT col, sum(support) AS total FROM val WHERE sig <> '<na>' GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY support DESC, first_row) AS rank FROM val WHERE sig <> '<na>')
 SELECT col AS "column", sig, support AS n, round(support / total, 9) AS ratio, first_raw, rank FROM r JOIN t USING (col) WHERE rank <= 20""")
def top_values_topk(spark, d):
    return pr.top_values(ce.values(part_cells(spark, d))).withColumn("ratio", F.round("ratio", 9))


@query(VALUES + """, r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY support DESC, first_row) AS rank FROM val WHERE sig <> '<na>' AND support <= 3)
 SELECT col AS "column", sig, support AS n, rank FROM r WHERE rank <= 20""")
def low_frequency_values(spark, d):
    return pr.low_frequency_values(ce.values(part_cells(spark, d)))


@query(VALUES + """, r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY support DESC, sig) AS rank FROM val WHERE sig <> '<na>')
 SELECT col AS "column", count(*) AS unique_count, round(count(*) / sum(support), 9) AS unique_ratio, round(count(*) FILTER (support = 1) / count(*), 9) AS singleton_ratio,
  round(sum(support) FILTER (rank <= 10) / sum(support), 9) AS top10_coverage, round(coalesce(sum(support) FILTER (sig LIKE '%\\%' ESCAPE '\\'), 0) / sum(support), 9) AS percent_ratio FROM r GROUP BY 1""")
def singleton_stats(spark, d):
    u = pr.uniqueness(ce.values(part_cells(spark, d)))
    return u.select("column", "unique_count", *[F.round(c, 9).alias(c) for c in ("unique_ratio", "singleton_ratio", "top10_coverage", "percent_ratio")])


@query(PART_CELLS + """, c AS (SELECT col, CAST(length(trim(raw)) AS INTEGER) AS length, count(*) AS n FROM cell WHERE raw IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY length) AS rank FROM c) SELECT col AS "column", length, n, rank FROM r WHERE rank <= 20""")
def length_distribution(spark, d):
    return pr.lengths(part_cells(spark, d))


@query(PART_CELLS + f""", c AS (SELECT col, CASE WHEN trim(raw) = '' THEN '<empty>' ELSE {SHAPE.format('raw')} END AS shape, count(*) AS n FROM cell WHERE raw IS NOT NULL GROUP BY 1, 2),
 t AS (SELECT col, sum(n) AS total FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, shape) AS rank FROM c)
 SELECT col AS "column", shape, n, round(n / total, 9) AS ratio, rank FROM r JOIN t USING (col) WHERE rank <= 20""")
def shape_distribution(spark, d):
    return pr.distribution(part_cells(spark, d), text.shape(F.col("raw")), "shape").withColumn("ratio", F.round("ratio", 9))


GRAMMAR = """array_to_string(list_transform(regexp_extract_all(trim({0}), '([\\-_/.:\\s]+|[^\\-_/.:\\s]+)', 1), lambda s: CASE
  WHEN regexp_matches(s, '^[\\-_/.:\\s]') THEN '<' || CASE WHEN regexp_matches(s, '^\\s') THEN ' ' ELSE substr(s, 1, 1) END || ':' || length(s) || '>'
  WHEN regexp_full_match(s, '[0-9]+') THEN 'D' || length(s) WHEN regexp_full_match(s, '[A-Za-z]+') THEN 'A' || length(s)
  WHEN regexp_full_match(s, '[0-9A-Za-z]+') THEN 'M' || length(s) ELSE 'X' || length(s) END), '|')"""


@query(PART_CELLS + f""", c AS (SELECT col, CASE WHEN trim(raw) = '' THEN '<empty>' ELSE {GRAMMAR.format('raw')} END AS grammar, count(*) AS n FROM cell WHERE raw IS NOT NULL GROUP BY 1, 2),
 t AS (SELECT col, sum(n) AS total FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, grammar) AS rank FROM c)
 SELECT col AS "column", grammar, n, round(n / total, 9) AS ratio, rank FROM r JOIN t USING (col) WHERE rank <= 20""")
def grammar_distribution(spark, d):
    return pr.distribution(part_cells(spark, d), text.grammar(F.col("raw")), "grammar").withColumn("ratio", F.round("ratio", 9))


@query(PART_CELLS + """, e AS (SELECT col, unnest(regexp_extract_all(lower(raw), '([a-z0-9]+)', 1)) AS token FROM cell WHERE raw IS NOT NULL),
 c AS (SELECT col, token, count(*) AS n FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, token) AS rank FROM c)
 SELECT col AS "column", token, n, rank FROM r WHERE rank <= 20""")
def token_support(spark, d):
    return pr.token_support(part_cells(spark, d))


@query(PART_CELLS + f""", b AS (SELECT col, {COLLAPSED.format('raw')} AS v FROM cell WHERE raw IS NOT NULL),
 e AS (SELECT col, unnest(list_distinct(CASE WHEN length(v) >= 3 THEN list_transform(range(1, length(v) - 1), lambda k: substr(v, k, 3)) WHEN v <> '' THEN [v] ELSE [] END)) AS gram FROM b),
 c AS (SELECT col, gram, count(*) AS n FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, gram) AS rank FROM c)
 SELECT col AS "column", gram, n, rank FROM r WHERE rank <= 20""")
def char_trigram_support(spark, d):
    return pr.trigram_support(part_cells(spark, d))


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df, *keys):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _num_sql(c: str) -> str:
    q = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {n}" for n, p in pr.PERCENTILES.items())
    return (f"SELECT '{c}' AS \"column\", count({c}) AS n, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, {q}, "
            f"round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr FROM lineitem")


@query(" UNION ALL ".join(map(_num_sql, LINE_NUMBERS)))
def numeric_profile(spark, d):
    return _rounded(pr.numeric_profile(table(spark, d, "lineitem"), LINE_NUMBERS))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(median({c}), 6) AS median, round(mad({c}), 6) AS mad FROM lineitem" for c in LINE_NUMBERS))
def mad_profile(spark, d):
    return _rounded(pr.medians(table(spark, d, "lineitem"), LINE_NUMBERS))


@query(PART_CELLS + """, x AS (SELECT DISTINCT col, CAST(raw AS DOUBLE) AS x FROM cell WHERE regexp_full_match(trim(raw), '[+-]?[0-9]+(\\.[0-9]*)?')),
 r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY x) AS lo, row_number() OVER (PARTITION BY col ORDER BY x DESC) AS hi FROM x)
 SELECT col AS "column", x, lo AS rank, 'low' AS side FROM r WHERE lo <= 3 UNION ALL SELECT col, x, hi, 'high' FROM r WHERE hi <= 3""")
def numeric_extremes(spark, d):
    return pr.extremes(part_cells(spark, d))


PATTERNS = {"p_brand": ["Brand#[0-9]{2}", "[A-Za-z]+"], "p_size": ["[0-9]+", "[0-9]{2}"]}


@query(PART_CELLS + ", p AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, '{p}' AS pattern" for c, ps in PATTERNS.items() for p in ps) + """)
 SELECT col AS "column", pattern, count(*) AS n, round(avg(CAST(regexp_full_match(trim(raw), pattern) AS INTEGER)), 9) AS rate FROM cell JOIN p USING (col) WHERE raw IS NOT NULL GROUP BY 1, 2""")
def regex_candidate_rates(spark, d):
    return pr.regex_rates(part_cells(spark, d), PATTERNS).withColumn("rate", F.round("rate", 9))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS p01, quantile_cont(o_totalprice, 0.05) AS p05, quantile_cont(o_totalprice, 0.95) AS p95, quantile_cont(o_totalprice, 0.99) AS p99 FROM orders)
 SELECT o_orderkey, round(CASE WHEN o_totalprice < p01 OR o_totalprice > p99 THEN 1.0 WHEN o_totalprice < p05 THEN least(1.0, 0.4 + (p05 - o_totalprice) / greatest(p05 - p01, 1e-6))
  ELSE least(1.0, 0.4 + (o_totalprice - p95) / greatest(p99 - p95, 1e-6)) END, 6) AS strength FROM orders, q WHERE o_totalprice < p05 OR o_totalprice > p95""")
def numeric_rarity(spark, d):
    o = table(spark, d, "orders")
    q = pr.numeric_profile(o, ["o_totalprice"]).select("p01", "p05", "p95", "p99")  # one row
    s = numeric.rarity(*[F.col(c) for c in ("o_totalprice", "p01", "p05", "p95", "p99")])
    return o.select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(q)).where((F.col("o_totalprice") < F.col("p05")) | (F.col("o_totalprice") > F.col("p95"))).select("o_orderkey", F.round(s, 6).alias("strength"))


@query("""WITH m AS (SELECT median(l_extendedprice) AS med, mad(l_extendedprice) AS mad FROM lineitem)
 SELECT l_orderkey, l_linenumber, round(least(1.0, abs(l_extendedprice - med) / greatest(mad, 1e-9) / 8), 6) AS score FROM lineitem, m WHERE abs(l_extendedprice - med) > 1.9 * mad""")
def robust_z_outliers(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    m = pr.medians(li, ["l_extendedprice"]).select("median", "mad")  # one row
    far = F.abs(F.col("l_extendedprice") - F.col("median")) > 1.9 * F.col("mad")
    return li.crossJoin(F.broadcast(m)).where(far).select("l_orderkey", "l_linenumber", F.round(numeric.robust_z(F.col("l_extendedprice"), F.col("median"), F.col("mad")), 6).alias("score"))


NGRAMS = "list_distinct(CASE WHEN length({0}) >= 3 THEN list_transform(range(1, length({0}) - 1), lambda k: substr(lower({0}), k, 3)) WHEN {0} <> '' THEN [lower({0})] ELSE [] END)"
WORDS = "list_distinct(regexp_extract_all(lower({0}), '([a-z0-9]+)', 1))"
JACCARD = "(CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 0 END)"
SIMILAR = ("(0.55 * (1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b))) + 0.25 * " + JACCARD.format(NGRAMS.format("a"), NGRAMS.format("b"))
           + " + 0.20 * " + JACCARD.format(WORDS.format("a"), WORDS.format("b")) + ")")
PROTOTYPES = """WITH v AS (SELECT p_type AS a, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1), p AS (SELECT a AS b FROM v ORDER BY n DESC, k LIMIT 10)"""


def _prototypes(spark, d):
    v = table(spark, d, "part").groupBy(F.col("p_type").alias("a")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("k"))
    p = v.orderBy(F.desc("n"), "k").limit(10).select(F.col("a").alias("b"))  # ten rows
    return v.crossJoin(F.broadcast(p)).select("a", "b", text.similarity(F.col("a"), F.col("b")).alias("s"))


@query(PROTOTYPES + f" SELECT a, b, round({SIMILAR}, 6) AS s FROM v, p")
def prototype_similarity(spark, d):
    return _prototypes(spark, d).withColumn("s", F.round("s", 6))


@query(PROTOTYPES + f""", s AS (SELECT a, max({SIMILAR}) AS best FROM v, p GROUP BY 1)
 SELECT a, round(best, 6) AS best, round(CASE WHEN best >= 0.88 THEN least(1.0, 0.4 + 0.6 * best) ELSE 0 END, 6) AS near, round(CASE WHEN best <= 0.35 THEN least(1.0, 0.5 + (0.35 - best)) ELSE 0 END, 6) AS far FROM s""")
def prototype_nearest(spark, d):
    best = _prototypes(spark, d).groupBy("a").agg(F.max("s").alias("best"))
    near, far = text.prototype_evidence(F.col("best"))
    return best.select("a", F.round("best", 6).alias("best"), F.round(near, 6).alias("near"), F.round(far, 6).alias("far"))


PAIRS = ("WITH src AS (" + CUSTOMER_SQL + "), wide AS (SELECT row_idx, " + ", ".join(f"{SIG.format(c)} AS {c}" for c in CUSTOMER_COLUMNS) + " FROM src), pair AS ("
         + " UNION ALL ".join(f"SELECT row_idx, '{a}' AS ctx, {a} AS ctx_sig, '{b}' AS tgt, {b} AS tgt_sig FROM wide" for a in CUSTOMER_COLUMNS for b in CUSTOMER_COLUMNS if a != b)
         + f"), cnt AS (SELECT ctx, ctx_sig, tgt, tgt_sig, count(*) AS n, min(row_idx) AS min_row FROM pair WHERE ctx_sig NOT IN ('<na>', '<empty>', {_list(t for t in text.RULE_MISSING if t)}) GROUP BY 1, 2, 3, 4),"
         " g0 AS (SELECT ctx, tgt, ctx_sig, sum(n) AS g, sum(n * ln(n)) AS s FROM cnt GROUP BY 1, 2, 3), w0 AS (SELECT ctx, tgt, sum(g * ln(g) - s) AS hw FROM g0 GROUP BY 1, 2),"
         " t0 AS (SELECT ctx, tgt, tgt_sig, sum(n) AS t FROM cnt GROUP BY 1, 2, 3), o0 AS (SELECT ctx, tgt, sum(t) * ln(sum(t)) - sum(t * ln(t)) AS h FROM t0 GROUP BY 1, 2),"
         " pred AS (SELECT ctx, tgt, CASE WHEN h <= 1e-12 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - hw / h)) END AS predictiveness FROM w0 JOIN o0 USING (ctx, tgt))")


@query(PAIRS + " SELECT ctx, tgt, round(predictiveness, 6) AS predictiveness FROM pred")
def predictiveness_pairs(spark, d):
    return re_.predictiveness(re_.pair_counts(dirty_customer(spark, d), CUSTOMER_COLUMNS)).withColumn("predictiveness", F.round("predictiveness", 6))


MODES = PAIRS + (", md AS (SELECT ctx, tgt, ctx_sig, sum(n) AS g, max(n) AS mode_n, count(*) AS n_targets FROM cnt GROUP BY 1, 2, 3),"
                 " ms AS (SELECT ctx, tgt, ctx_sig, tgt_sig AS mode_sig FROM (SELECT *, row_number() OVER (PARTITION BY ctx, tgt, ctx_sig ORDER BY n DESC, min_row) AS r FROM cnt) WHERE r = 1)")


@query(MODES + " SELECT ctx, tgt, ctx_sig, CAST(g AS BIGINT) AS g, mode_sig, mode_n, n_targets FROM md JOIN ms USING (ctx, tgt, ctx_sig)")
def context_modes(spark, d):
    return re_.modes(re_.pair_counts(dirty_customer(spark, d), CUSTOMER_COLUMNS))


_ORD = "CASE ctx " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(CUSTOMER_COLUMNS)) + " END"
CONSENSUS = MODES + f""", rel AS (SELECT md.*, mode_sig, predictiveness FROM md JOIN ms USING (ctx, tgt, ctx_sig) JOIN pred USING (ctx, tgt)
   WHERE predictiveness >= 0.20 AND g >= 3 AND mode_n >= 3 AND mode_n / g >= 0.80),
 met AS (SELECT pair.row_idx, ctx, tgt, CASE WHEN tgt_sig = mode_sig THEN 'clean' ELSE 'dirty' END AS polarity, mode_sig AS expected,
   least(1.0, predictiveness * ln(g) / ln(1 + greatest((SELECT count(*) FROM src), 2))) * CASE WHEN tgt_sig = mode_sig THEN n / g ELSE 1 - n / g END AS strength
   FROM pair JOIN rel USING (ctx, tgt, ctx_sig) JOIN cnt USING (ctx, ctx_sig, tgt, tgt_sig) WHERE tgt_sig NOT IN ('<na>', '<empty>', {_list(t for t in text.RULE_MISSING if t)})),
 best AS (SELECT *, row_number() OVER (PARTITION BY row_idx, tgt, polarity ORDER BY round(strength, 12) DESC, {_ORD}) AS r FROM met)
 SELECT row_idx, tgt, ctx, expected, round(strength, 6) AS strength FROM best WHERE r = 1"""


def _consensus(spark, d, polarity):
    c = dirty_customer(spark, d)
    return re_.consensus(c, CUSTOMER_COLUMNS, c.count()).where(F.col("polarity") == polarity).select("row_idx", "tgt", "ctx", "expected", F.round("strength", 6).alias("strength"))


@query(CONSENSUS + " AND polarity = 'dirty'")
def context_disagreement(spark, d):
    return _consensus(spark, d, "dirty")


@query(CONSENSUS + " AND polarity = 'clean'")
def context_agreement(spark, d):
    return _consensus(spark, d, "clean")


@query(MODES + """, ok AS (SELECT ctx_sig, mode_sig FROM md JOIN ms USING (ctx, tgt, ctx_sig) WHERE ctx = 'nationkey' AND tgt = 'nation' AND g >= 3 AND mode_n >= 3 AND mode_n / g >= 0.80),
 r AS (SELECT w.nationkey AS ctx_sig, w.nation AS mode_sig, row_idx, row_number() OVER (PARTITION BY w.nationkey ORDER BY row_idx) AS rank FROM wide w JOIN ok ON w.nationkey = ok.ctx_sig AND w.nation = ok.mode_sig)
 SELECT * FROM r WHERE rank <= 5""")
def context_reference_rows(spark, d):
    return re_.reference_rows(dirty_customer(spark, d), "nationkey", "nation")


FD_PAIRS = [("nationkey", "nation"), ("nation", "region"), ("region", "nation"), ("c_mktsegment", "region")]
FD_SQL = "WITH src AS (" + CUSTOMER_SQL + "), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS k, {a} AS kv, '{b}' AS d, {b} AS dv FROM src WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in FD_PAIRS) + """),
 e AS (SELECT k, d, kv, count(DISTINCT dv) AS n_values, count(*) AS n FROM p GROUP BY 1, 2, 3)"""


@query(FD_SQL + """ SELECT k, d, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, round(avg(CAST(n_values = 1 AS INTEGER)), 9) AS single_share,
 sum(n) >= 50 AND avg(CAST(n_values = 1 AS INTEGER)) >= 0.90 AS accepted FROM e GROUP BY 1, 2""")
def fd_candidates(spark, d):
    return re_.dependencies(dirty_customer(spark, d), FD_PAIRS).withColumn("single_share", F.round("single_share", 9))


@query(MODES + """ SELECT row_idx, pair.tgt_sig AS found, mode_sig AS expected FROM pair JOIN md USING (ctx, tgt, ctx_sig) JOIN ms USING (ctx, tgt, ctx_sig)
 WHERE ctx = 'nationkey' AND tgt = 'nation' AND mode_n / g >= 0.5 AND mode_n >= 2 AND pair.tgt_sig <> mode_sig""")
def fd_violations(spark, d):
    df = dirty_customer(spark, d)
    m = re_.modes(re_.pair_counts(df, ["nationkey", "nation"])).where("ctx = 'nationkey' and mode_n / g >= 0.5 and mode_n >= 2").select("ctx_sig", "mode_sig")
    rows = df.select("row_idx", text.signature(F.col("nationkey")).alias("ctx_sig"), text.signature(F.col("nation")).alias("found"))
    return rows.join(m, "ctx_sig").where(F.col("found") != F.col("mode_sig")).select("row_idx", "found", F.col("mode_sig").alias("expected"))


@query(f"""WITH src AS ({PART_SQL}), a AS (SELECT {COLLAPSED.format("coalesce(p_brand, '')")} AS b, {COLLAPSED.format("coalesce(clean_brand, '')")} AS c, p_brand IS NULL AS gone FROM src),
 f AS (SELECT NOT gone AND b NOT IN ({_list(text.RULE_MISSING)}) AS ok, starts_with(b, c) AS holds FROM a)
 SELECT 'prefix_match' AS kind, count(*) FILTER (ok) AS n_applicable, count(*) FILTER (ok AND NOT holds) AS n_violations, round(count(*) FILTER (ok AND NOT holds) / count(*) FILTER (ok), 9) AS violation_rate FROM f""")
def relationship_profile(spark, d):
    return re_.relation_profile(dirty_part(spark, d), "p_brand", "clean_brand", "prefix_match").withColumn("violation_rate", F.round("violation_rate", 9))


@query("SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 15")
def cooccurrence_topk(spark, d):
    return re_.cooccurrence(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


SURFACE = ("CASE WHEN regexp_full_match(t, '[-+]?[0-9]+(\\.[0-9]+)?\\s*%') THEN 'numeric_percent_suffix' WHEN regexp_full_match(t, '[-+]?[0-9]+(\\.[0-9]+)?') THEN 'plain_numeric' "
           "WHEN regexp_full_match(t, '[-+]?[0-9]+(\\.[0-9]+)?\\s+[^0-9\\s].*') THEN 'numeric_with_suffix' WHEN regexp_full_match(t, '[A-Za-z\\s\\-_/''().&]+') THEN 'lexical' "
           "WHEN regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Za-z]') THEN 'mixed_alphanumeric' ELSE 'other' END")


@query(PART_CELLS + f", s AS (SELECT col, coalesce(trim(raw), '') AS t FROM cell) SELECT col AS \"column\", {SURFACE} AS surface, count(*) AS n FROM s GROUP BY 1, 2")
def surface_classes(spark, d):
    return pr.surfaces(part_cells(spark, d))


@query(PART_CELLS + """, t AS (SELECT col, lower(trim(raw)) AS t FROM cell WHERE raw IS NOT NULL AND length(trim(raw)) >= 4),
 e AS (SELECT col, 'prefix' AS side, left(t, 4) AS affix FROM t UNION ALL SELECT col, 'suffix', right(t, 4) FROM t), c AS (SELECT col, side, affix, count(*) AS n FROM e GROUP BY 1, 2, 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY col, side ORDER BY n DESC, affix) AS rank FROM c) SELECT col AS "column", side, affix, n, rank FROM r WHERE rank <= 10""")
def affix_profile(spark, d):
    return pr.affixes(part_cells(spark, d))
