"""Queries of evidence, rules, repair, evaluation and the older operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from veracell.functions import numeric, text
from veracell.operators import archive as ar
from veracell.operators import cells as ce
from veracell.operators import dual as du
from veracell.operators import evaluate as ev
from veracell.operators import evidence as evi
from veracell.operators import inference as inf
from veracell.operators import repair as rp
from veracell.operators import rules as ru
from veracell.operators.quantiles import exact
from veracell.operators.rules import Rule

from .catalogue import COLLAPSED, GRAMMAR, PART_SQL, SHAPE, _list, cells_sql, query, table
from .detect import DetectConfig, detect
from .inputs import dirty_part

# ---- evidence of two columns, the same generators in SQL

COLUMNS = ["p_brand", "p_size"]
CONFIG = DetectConfig(columns=COLUMNS, kinds={"p_brand": "categorical", "p_size": "numeric"}, archetypes={"p_brand": "closed_enum", "p_size": "numeric_measure"},
                      patterns={"p_brand": "Brand#[0-9]{2}"}, clean={"p_brand": "clean_brand", "p_size": "clean_size"})
BASE = "ln(0.05 / 0.95)"
MISSING = f"(raw IS NULL OR {COLLAPSED.format('raw')} IN ({_list(text.RULE_MISSING)}))"
NUMBER = "CASE WHEN regexp_full_match(trim(raw), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trim(raw) AS DOUBLE) END"
SIGMOID = "(1 / (1 + exp(-({0}))))"
OBS = cells_sql(COLUMNS, PART_SQL) + f""", n0 AS (SELECT count(*) AS n FROM src), val0 AS (SELECT col, sig, count(*) AS support, arg_min(raw, row_idx) AS raw FROM cell GROUP BY 1, 2),
 par AS (SELECT col, avg(CAST(({NUMBER}) IS NOT NULL AS INTEGER)) AS parsed, quantile_cont({NUMBER}, 0.01) AS p01, quantile_cont({NUMBER}, 0.05) AS p05, quantile_cont({NUMBER}, 0.95) AS p95, quantile_cont({NUMBER}, 0.99) AS p99 FROM cell GROUP BY 1),
 gr AS (SELECT col, CASE WHEN trim(raw) = '' THEN '<empty>' ELSE {GRAMMAR.format('raw')} END AS k, count(*) AS n FROM cell WHERE raw IS NOT NULL GROUP BY 1, 2),
 sh AS (SELECT col, CASE WHEN trim(raw) = '' THEN '<empty>' ELSE {SHAPE.format('raw')} END AS k, count(*) AS n FROM cell WHERE raw IS NOT NULL GROUP BY 1, 2),
 tt AS (SELECT col, count(*) AS total FROM cell WHERE raw IS NOT NULL GROUP BY 1), okg AS (SELECT col, k FROM gr JOIN tt USING (col) WHERE n / total >= 0.05), oks AS (SELECT col, k FROM sh JOIN tt USING (col) WHERE n / total >= 0.05),
 v AS (SELECT val0.col, sig, support, {MISSING} AS gone, support >= 5 AND support / n >= 0.02 AS st, {NUMBER} AS x, par.*, coalesce(val0.col = 'p_brand' AND regexp_full_match(trim(raw), 'Brand#[0-9]{{2}}'), false) AS m, val0.col = 'p_size' AS num FROM val0 JOIN par USING (col), n0),
 c AS (SELECT row_idx, cell.col, support, {MISSING.replace('raw', 'cell.raw')} AS gone, support >= 5 AND support / n >= 0.02 AS st, {NUMBER.replace('raw', 'cell.raw')} AS x, parsed, coalesce(cell.col = 'p_brand' AND regexp_full_match(trim(cell.raw), 'Brand#[0-9]{{2}}'), false) AS m, cell.col = 'p_size' AS num,
  NOT (CASE WHEN cell.raw IS NULL OR trim(cell.raw) = '' THEN '<empty>' ELSE {GRAMMAR.format('cell.raw')} END IN (SELECT k FROM okg WHERE okg.col = cell.col)) OR NOT (CASE WHEN cell.raw IS NULL OR trim(cell.raw) = '' THEN '<empty>' ELSE {SHAPE.format('cell.raw')} END IN (SELECT k FROM oks WHERE oks.col = cell.col)) AS odd
  FROM cell JOIN val0 USING (col, sig) JOIN par USING (col), n0),
 vo AS (SELECT col, sig, 'missing_token' AS source, 'missing' AS family, 'dirty' AS polarity, CASE WHEN st THEN 0.15 ELSE 1.0 END AS strength, NOT st AS hard FROM v WHERE gone
  UNION ALL SELECT col, sig, unnest(['parse_failure', 'type_conflict']), 'outlier', 'dirty', 1.0, parsed >= 0.8 FROM v WHERE NOT gone AND num AND x IS NULL
  UNION ALL SELECT col, sig, 'parser_success', 'outlier', 'clean', 1.0, false FROM v WHERE NOT gone AND num AND x IS NOT NULL
  UNION ALL SELECT * FROM (SELECT col, sig, 'rarity_high', 'outlier', 'dirty', CASE WHEN x < p01 OR x > p99 THEN 1.0 WHEN x < p05 THEN least(1.0, 0.4 + (p05 - x) / greatest(p05 - p01, 1e-6)) WHEN x > p95 THEN least(1.0, 0.4 + (x - p95) / greatest(p99 - p95, 1e-6)) ELSE 0 END AS s, false FROM v WHERE NOT gone AND num AND x IS NOT NULL) WHERE s > 0
  UNION ALL SELECT col, sig, 'regex_pass', 'pattern', 'clean', 1.0, false FROM v WHERE NOT gone AND NOT num AND m
  UNION ALL SELECT col, sig, 'parser_success', 'pattern', 'clean', 0.8, false FROM v WHERE NOT gone AND NOT num AND m
  UNION ALL SELECT col, sig, 'rarity_high', 'pattern', 'dirty', CASE support WHEN 1 THEN 0.8 WHEN 2 THEN 0.65 ELSE 0.5 END, false FROM v WHERE NOT gone AND NOT num AND support <= 3),
 co AS (SELECT row_idx, col, 'missing_token' AS source, 'missing' AS family, 'dirty' AS polarity, CASE WHEN st THEN 0.15 ELSE 1.0 END AS strength, NOT st AS hard FROM c WHERE gone
  UNION ALL SELECT row_idx, col, unnest(['cell_parse_failure', 'cell_type_conflict']), 'outlier', 'dirty', 1.0, parsed >= 0.8 FROM c WHERE NOT gone AND num AND x IS NULL
  UNION ALL SELECT row_idx, col, 'pattern_match', 'pattern', 'clean', 1.0, false FROM c WHERE NOT gone AND NOT num AND m
  UNION ALL SELECT row_idx, col, 'pattern_mismatch', 'pattern', 'dirty', 1.0, false FROM c WHERE NOT gone AND NOT num AND NOT m AND odd
  UNION ALL SELECT row_idx, col, 'cell_parser_success', 'outlier', 'clean', 1.0, false FROM c WHERE NOT gone AND num AND x IS NOT NULL),
 obs AS (SELECT row_idx, col, 'value' AS scope, source, family, polarity, strength, hard FROM cell JOIN vo USING (col, sig) UNION ALL SELECT row_idx, col, 'cell', source, family, polarity, strength, hard FROM co),
 ft AS (SELECT row_idx, col, scope || ':' || family || ':' || source AS feature, sum(CASE polarity WHEN 'dirty' THEN strength ELSE -strength END) AS x FROM obs GROUP BY 1, 2, 3),
 ps AS (SELECT row_idx, col, greatest(-30, least(30, {BASE} + sum(x))) AS logit FROM ft GROUP BY 1, 2), po AS (SELECT *, {SIGMOID.format('logit')} AS posterior FROM ps)"""


def seen(spark, d):
    """The distinct raw values, and the observations of the first cell of each."""
    forms = ce.Forms(dirty_part(spark, d), COLUMNS)
    value = ce.values(forms.rows)
    x = forms.rows.where("column = 'p_size'").select("column", "n", numeric.strict(F.col("raw")).alias("x"))
    q = exact(x, [0.01, 0.05, 0.95, 0.99])["p_size"]
    specs = evi.infer_specs(value, forms.rows, CONFIG.kinds, CONFIG.patterns, {"p_size": dict(zip(("p01", "p05", "p95", "p99"), q))}, CONFIG.archetypes)
    return forms, evi.on_cells(forms.rows, evi.value_evidence(value, specs), evi.cell_evidence(forms.rows, value, specs))


@query(OBS + ' SELECT row_idx, col AS "column", feature, round(x, 6) AS x FROM ft')
def evidence_features(spark, d):
    forms, obs = seen(spark, d)
    return forms.to_cells(inf.features(obs).withColumn("x", F.round("x", 6)))


@query(OBS + " SELECT scope, source, polarity, count(DISTINCT (row_idx, col)) AS n_cells, count(*) AS n FROM obs GROUP BY 1, 2, 3")
def evidence_coverage(spark, d):
    forms, obs = seen(spark, d)
    return evi.coverage(forms.weighted(obs))


@query(OBS + """ SELECT row_idx, col AS "column", CASE WHEN bool_or(polarity = 'dirty') THEN 'hard_dirty' ELSE 'hard_clean' END AS label, array_to_string(list_sort(list_distinct(list(source))), ',') AS reasons FROM obs WHERE hard GROUP BY 1, 2""")
def hard_labels(spark, d):
    forms, obs = seen(spark, d)
    return forms.to_cells(evi.hard_labels(obs))


def _gate_sql(scale):
    g = {c: dict(zip(inf.GATED, inf.GATES[a])) for c, a in CONFIG.archetypes.items()}
    arms = " ".join(f"WHEN NOT hard AND col = '{c}' AND source = '{s}' THEN {scale(t)!r}" for c, gs in g.items() for s, t in gs.items())
    return OBS + f', g AS (SELECT *, CASE {arms} ELSE 1.0 END AS gate_scale FROM obs) SELECT row_idx, col AS "column", scope, source, round(strength * gate_scale, 6) AS strength, round(gate_scale, 6) AS gate_scale FROM g WHERE gate_scale < 1'


def _gated(spark, d, **k):
    forms, obs = seen(spark, d)
    out = inf.gate(obs, CONFIG.archetypes, **k).where("gate_scale < 1")
    return forms.to_cells(out.select("row_idx", "column", "scope", "source", F.round("strength", 6).alias("strength"), F.round("gate_scale", 6).alias("gate_scale")))


@query(_gate_sql(lambda t: t))
def gate_hard(spark, d):
    return _gated(spark, d)


@query(_gate_sql(lambda t: 1 - 0.2 * (1 - t)))
def gate_weak_prior(spark, d):
    return _gated(spark, d, mode="weak_prior", confidence={c: 0.8 for c in COLUMNS})


INTERCEPT = -2.9444389791664403


def weighed(spark, d):
    forms, obs = seen(spark, d)
    return forms, obs, inf.posteriors(inf.features(obs), INTERCEPT, None)


@query(OBS + ' SELECT row_idx, col AS "column", round(logit, 6) AS logit, round(posterior, 6) AS posterior FROM po')
def posterior_scores(spark, d):
    forms, _, post = weighed(spark, d)
    return forms.to_cells(post.select("row_idx", "column", F.round("logit", 6).alias("logit"), F.round("posterior", 6).alias("posterior")))


@query(OBS + f' SELECT cell.col AS "column", sig, round(avg(coalesce(posterior, {SIGMOID.format(BASE)})), 6) AS prior, count(*) AS n FROM cell LEFT JOIN po ON cell.row_idx = po.row_idx AND cell.col = po.col GROUP BY 1, 2')
def value_priors(spark, d):
    forms, _, post = weighed(spark, d)
    return inf.value_priors(forms.rows, post, INTERCEPT).withColumn("prior", F.round("prior", 6))


SIGNED = "CASE polarity WHEN 'dirty' THEN strength ELSE -strength END"
CONTRIB = (OBS + f", ct AS (SELECT obs.row_idx, obs.col, scope, source, posterior, logit, {SIGNED} AS w, posterior - {SIGMOID.format(f'greatest(-30, least(30, logit - {SIGNED}))')} AS contribution "
           "FROM obs JOIN po ON obs.row_idx = po.row_idx AND obs.col = po.col)")


@query(CONTRIB + ' SELECT row_idx, col AS "column", scope, source, round(contribution, 6) AS contribution FROM ct')
def loeo_contributions(spark, d):
    forms, obs, post = weighed(spark, d)
    return forms.to_cells(inf.contributions(obs, post, None).select("row_idx", "column", "scope", "source", F.round("contribution", 6).alias("contribution")))


TRUTH = (f", tr AS (SELECT row_idx, 'p_brand' AS col, p_brand AS dirty, clean_brand AS clean FROM src UNION ALL SELECT row_idx, 'p_size', p_size, clean_size FROM src), "
         f"lb AS (SELECT row_idx, col, dirty, clean, CASE WHEN dirty IS NOT DISTINCT FROM clean OR ({MISSING.replace('raw', 'dirty')} AND {MISSING.replace('raw', 'clean')}) THEN 0 ELSE 1 END AS label FROM tr)")
LABELLED = " fl AS (SELECT po.row_idx, po.col, posterior, label, CAST(posterior >= 0.2 AS INTEGER) AS predicted FROM po JOIN lb ON po.row_idx = lb.row_idx AND po.col = lb.col)"


def labelled(spark, d):
    forms, _, post = weighed(spark, d)
    t = ev.truth(dirty_part(spark, d), CONFIG.clean).select("row_idx", "column", F.col("dirty").alias("raw"), "label")
    return forms.to_cells(post, t).withColumn("predicted", (F.col("posterior") >= 0.2).cast("int"))


@query(OBS + TRUTH + "," + LABELLED + """, g AS (SELECT col, count(*) AS n, max(posterior) FILTER (label = 0) AS c, min(posterior) FILTER (label = 1) AS d FROM fl GROUP BY 1)
 SELECT col AS "column", n, round(greatest(0.05, least(0.95, (1 - n / (n + 5.0)) * 0.5 + n / (n + 5.0) * CASE WHEN c < d THEN (c + d) / 2 WHEN c IS NOT NULL THEN greatest(0.5, c + 0.05) ELSE least(0.5, d - 0.05) END)), 6) AS threshold FROM g WHERE n >= 2""")
def column_thresholds(spark, d):
    return inf.thresholds(labelled(spark, d)).select("column", "n", F.round("threshold", 6).alias("threshold"))


PRF = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"
COUNTS = "count(*) FILTER (predicted = 1 AND label = 1) AS tp, count(*) FILTER (predicted = 1 AND label = 0) AS fp, count(*) FILTER (predicted = 0 AND label = 1) AS fn"


def _prf(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


@query(OBS + TRUTH + "," + LABELLED + f", m AS (SELECT {COUNTS} FROM fl) SELECT tp, fp, fn, {PRF} FROM m")
def detection_metrics(spark, d):
    return _prf(ev.metrics(labelled(spark, d)))


@query(OBS + TRUTH + "," + LABELLED + f", m AS (SELECT coalesce(col, '<all>') AS col, {COUNTS} FROM fl GROUP BY ROLLUP (col)) SELECT col AS \"column\", tp, fp, fn, {PRF} FROM m")
def per_column_metrics(spark, d):
    return _prf(ev.metrics(labelled(spark, d), "column")).na.fill("<all>", ["column"])


@query(OBS + TRUTH + f""", e AS (SELECT CASE WHEN {MISSING.replace('raw', 'dirty')} THEN 'missing_value' WHEN {SHAPE.format('dirty')} <> {SHAPE.format('clean')} THEN 'pattern_violation' ELSE 'rule_violation' END AS gold, col AS predicted FROM lb WHERE label = 1)
 SELECT gold, predicted, count(*) AS n FROM e GROUP BY 1, 2""")
def error_type_confusion(spark, d):
    t = ev.truth(dirty_part(spark, d), CONFIG.clean).where("label = 1").withColumn("gold", ev.error_type(F.col("dirty"), F.col("clean")))
    return ev.confusion(t, "gold", "column")


@query(OBS + TRUTH + "," + LABELLED + """, t AS (SELECT unnest(range(1, 100)) AS k), s AS (SELECT CAST(floor(posterior * 100 + 1e-9) AS INTEGER) AS b, label FROM fl)
 SELECT round(k / 100, 6) AS threshold, count(*) FILTER (b >= k AND label = 1) AS tp, count(*) FILTER (b >= k AND label = 0) AS fp, count(*) FILTER (b < k AND label = 1) AS fn,
  round(CASE WHEN count(*) FILTER (label = 1 OR b >= k) > 0 THEN 2 * count(*) FILTER (b >= k AND label = 1) / (2 * count(*) FILTER (b >= k AND label = 1) + count(*) FILTER (b >= k AND label = 0) + count(*) FILTER (b < k AND label = 1)) ELSE 0 END, 6) AS f1 FROM s, t GROUP BY k""")
def threshold_sweep_f1(spark, d):
    return _prf(ev.threshold_sweep(labelled(spark, d).withColumnRenamed("posterior", "score")))


@query(CONTRIB + f""", r AS (SELECT *, row_number() OVER (PARTITION BY row_idx, col ORDER BY w DESC, source, scope) AS r FROM ct WHERE posterior >= 0.2),
 g AS (SELECT row_idx, col, any_value(posterior) AS p, any_value(logit) AS l, sum(CASE WHEN r <= 3 AND w > 0 THEN w ELSE 0 END) AS best, sum(w) AS total FROM r GROUP BY 1, 2)
 SELECT row_idx, col AS "column", round(p - {SIGMOID.format('l - best')}, 6) AS comprehensiveness, round(p - {SIGMOID.format('l - total + best')}, 6) AS sufficiency, {SIGMOID.format('l - best')} < 0.2 AS flips FROM g""")
def explanation_faithfulness(spark, d):
    forms, obs, post = weighed(spark, d)
    return _prf(forms.to_cells(ev.faithfulness(inf.contributions(obs, post, None), threshold=0.2)))


@query()
def dopt_queries(spark, d):
    """Cells to label first, by greedy design (rows only: an iterative algorithm)."""
    forms, obs = seen(spark, d)
    chosen = inf.choose_queries(forms.weighted(inf.evidence_vectors(inf.features(obs))), 10)
    return spark.createDataFrame([(k, r, c) for k, (r, c) in enumerate(chosen)], "place int, row_idx bigint, column string")


@query()
def calibrated_detection(spark, d):
    """The whole calibrated plan with explanations (rows only)."""
    return detect(dirty_part(spark, d), CONFIG).explanations


# ---- rules

ORDER_RULES = [Rule("price_range", "o_totalprice", "outlier", "lambda value, row=None: 1000 <= safe_float(value) <= 300000"),
               Rule("status_known", "o_orderstatus", "pattern", "lambda value, row=None: value in ('F', 'O')"),
               Rule("priority_form", "o_orderpriority", "pattern", "lambda value, row=None: bool(re.fullmatch(r'[1-5]-[A-Z ]+', str(value)))"),
               Rule("urgent_price", "o_totalprice", "relationship", "lambda value, row=None: safe_float(value) > 50000 if row['o_orderpriority'].startswith('1') else True")]
RULE_SQL = ["o_totalprice BETWEEN 1000 AND 300000", "o_orderstatus IN ('F', 'O')", "regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+')", "CASE WHEN starts_with(o_orderpriority, '1') THEN o_totalprice > 50000 ELSE true END"]


def _orders(spark, d):
    return ce.with_rows(table(spark, d, "orders"), "o_orderkey")


@query(" UNION ALL ".join(f"SELECT '{r.name}' AS rule, count(*) AS n, count(*) FILTER (NOT ({s})) AS n_violations, round(count(*) FILTER (NOT ({s})) / count(*), 9) AS rate FROM orders" for r, s in zip(ORDER_RULES, RULE_SQL)))
def rule_violation_rates(spark, d):
    return ru.violation_rates(_orders(spark, d), ORDER_RULES).withColumn("rate", F.round("rate", 9))


@query(" UNION ALL ".join(f"SELECT '{r.name}' AS rule, CASE WHEN count(*) FILTER ({s}) = 0 THEN 'degenerate: never true' WHEN count(*) FILTER ({s}) = count(*) THEN 'degenerate: always true' WHEN count(*) FILTER ({s}) / count(*) >= 0.5 THEN 'accepted' ELSE 'rejected' END AS verdict FROM orders" for r, s in zip(ORDER_RULES, RULE_SQL)))
def rule_acceptance(spark, d):
    got = ru.validate(_orders(spark, d), ORDER_RULES)
    return spark.createDataFrame([(r.name, v if v.startswith(("accepted", "degenerate")) else "rejected") for r, v in got], "rule string, verdict string")


@query("SELECT o_orderkey AS row_idx, " + ", ".join(f"{s} AS {r.name}" for r, s in zip(ORDER_RULES, RULE_SQL)) + " FROM orders")
def rule_outputs(spark, d):
    return ru.outputs(_orders(spark, d), ORDER_RULES)


CLEAN = [Rule("in_range", "o_totalprice", "outlier", "lambda value, row=None: safe_float(value) <= 250000"), ORDER_RULES[1]]
DIRTY = [Rule("large", "o_totalprice", "outlier", "lambda value, row=None: safe_float(value) > 200000"), Rule("pending", "o_orderstatus", "pattern", "lambda value, row=None: value == 'P'")]
ZONED = """WITH z AS (SELECT o_orderkey AS row_idx, *, o_totalprice <= 250000 AND o_orderstatus IN ('F', 'O') AS c, o_totalprice > 200000 OR o_orderstatus = 'P' AS x FROM orders),
 zz AS (SELECT *, CASE WHEN c AND x THEN 'conflict' WHEN c THEN 'clean' WHEN x THEN 'dirty' ELSE 'grey' END AS zone FROM z)"""


def _zoned(spark, d):
    return du.zones(_orders(spark, d), CLEAN, DIRTY)


@query(ZONED + " SELECT zone, count(*) AS n, round(count(*) / (SELECT count(*) FROM zz), 9) AS rate FROM zz GROUP BY 1")
def four_zone(spark, d):
    return du.four_zones(_zoned(spark, d)).withColumn("rate", F.round("rate", 9))


@query(ZONED + " , r AS (SELECT zone, row_idx, o_orderstatus, row_number() OVER (PARTITION BY zone ORDER BY row_idx) AS rank FROM zz) SELECT * FROM r WHERE rank <= 10")
def zone_samples(spark, d):
    return du.zone_samples(_zoned(spark, d), "o_orderstatus")


@query(ZONED + """, t AS (SELECT count(*) FILTER (c) AS n_clean, count(*) FILTER (x) AS n_dirty, count(*) FILTER (c AND x) AS n_both FROM zz)
 SELECT *, round(CASE WHEN n_clean + n_dirty - n_both > 0 THEN n_both / (n_clean + n_dirty - n_both) ELSE 0 END, 9) AS iou,
 CASE WHEN n_clean = 0 OR n_dirty = 0 OR n_both = 0 THEN 'disjoint' WHEN n_both / n_dirty >= 0.8 THEN 'subset' WHEN n_both / n_clean >= 0.8 THEN 'superset' ELSE 'intersect' END AS kind FROM t""")
def conflict_topology(spark, d):
    return du.topology(_zoned(spark, d)).withColumn("iou", F.round("iou", 9))


HITS = "concat_ws(',', CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END)"


@query(ZONED + f" SELECT row_idx, {HITS} AS hits FROM zz WHERE x AND NOT c")
def and_or_errors(spark, d):
    return du.errors(_orders(spark, d), DIRTY, CLEAN)


@query(ZONED + f" SELECT row_idx, {HITS} AS hits FROM zz WHERE x")
def or_only_errors(spark, d):
    return du.errors(_orders(spark, d), DIRTY, CLEAN, "or_only")


@query(ZONED + " SELECT row_idx, o_totalprice FROM zz WHERE zone = 'dirty'")
def determined_dirty(spark, d):
    return _zoned(spark, d).where("zone = 'dirty'").select("row_idx", "o_totalprice")


@query("WITH z AS (SELECT *, o_totalprice <= 250000 AND o_orderstatus = 'F' AS c, o_totalprice > 200000 OR o_orderstatus = 'P' AS x FROM orders) SELECT o_orderpriority AS value, count(*) AS n FROM z WHERE NOT c AND NOT x GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def gap_values(spark, d):
    strict = [CLEAN[0], Rule("final", "o_orderstatus", "pattern", "lambda value, row=None: value == 'F'")]
    return du.gap_values(du.zones(_orders(spark, d), strict, DIRTY), "o_orderpriority")


@query(ZONED + """, h AS (SELECT o_orderstatus AS value, 'large' AS rule FROM zz WHERE c AND o_totalprice > 200000 UNION ALL SELECT o_orderstatus, 'pending' FROM zz WHERE c AND o_orderstatus = 'P'),
 g AS (SELECT rule, value, count(*) AS n FROM h GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY n DESC, value) AS rank FROM g) SELECT * FROM r WHERE rank <= 10""")
def conflict_values(spark, d):
    return du.conflict_values(_orders(spark, d), "o_orderstatus", CLEAN, DIRTY)


@query()
def em_pattern_weights(spark, d):
    """Rule reliabilities by expectation maximisation (rows only)."""
    return ar.em_weights(ru.outputs(_orders(spark, d), ORDER_RULES), [r.name for r in ORDER_RULES])


# ---- repair

REPAIRS = [rp.Operation("strip_suffix", "p_size", suffix=" cm"), rp.Operation("regex_replace", "p_brand", pattern="x$", replacement="", confidence=0.7), rp.Operation("normalize_surface", "p_brand", mapping={"N/A": "unknown"}, confidence=0.6, ambiguity=1.0),
           rp.Operation("truncate_at_marker", "p_size", marker=" ", confidence=0.55)]


@query(f"""WITH src AS ({PART_SQL}), c AS (SELECT row_idx, 'p_size' AS col, 'strip_suffix' AS mechanism, trim(left(trim(p_size), length(trim(p_size)) - 3)) AS candidate, 0.8 AS score FROM src WHERE trim(p_size) LIKE '% cm'
 UNION ALL SELECT row_idx, 'p_brand', 'regex_replace', regexp_replace(trim(p_brand), 'x$', '', 'i'), 0.7 FROM src WHERE regexp_matches(trim(p_brand), 'x$', 'i')
 UNION ALL SELECT row_idx, 'p_brand', 'normalize_surface', 'unknown', 0.54 FROM src WHERE lower(trim(p_brand)) = 'n/a'
 UNION ALL SELECT row_idx, 'p_size', 'truncate_at_marker', split_part(trim(p_size), ' ', 1), 0.55 FROM src WHERE strpos(trim(p_size), ' ') > 1)
 SELECT row_idx, col AS "column", mechanism, candidate, round(score, 6) AS score, row_number() OVER (PARTITION BY row_idx, col ORDER BY score DESC, mechanism) AS rank FROM c""")
def repair_candidates(spark, d):
    return rp.candidates(dirty_part(spark, d), REPAIRS).withColumn("score", F.round("score", 6)).drop("ambiguity", "changed")


@query(f"""WITH src AS ({PART_SQL}), m AS (SELECT row_idx, p_brand AS dirty, clean_brand AS clean FROM src WHERE p_brand IS DISTINCT FROM clean_brand),
 e AS (SELECT *, levenshtein(coalesce(dirty, ''), clean) AS k, length(coalesce(dirty, '')) = length(clean) AS same FROM m)
 SELECT CASE WHEN same AND k = 1 THEN 'char_substitution' WHEN same AND k <= 3 THEN k || '_char_typo' WHEN NOT same AND k <= 3 THEN 'length_mismatch' ELSE 'major_difference' END AS kind, count(*) AS n FROM e GROUP BY 1""")
def typo_kinds(spark, d):
    return dirty_part(spark, d).where("not (p_brand <=> clean_brand)").groupBy(text.typo_kind(F.col("p_brand"), F.col("clean_brand")).alias("kind")).agg(F.count("*").alias("n"))


# ---- older operators and files

@query("""SELECT json_extract_string(props, '$.k') AS k, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2""")
def json_field_profile(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS other_id, list_cosine_similarity(a.v, b.v) AS c FROM e a, e b WHERE a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 9) DESC, other_id) AS rank FROM p) SELECT vec_id, other_id, round(c, 5) AS cosine, rank FROM r WHERE rank <= 5""")
def cosine_topk(spark, d):
    return ar.cosine_topk(table(spark, d, "embeddings").select("vec_id", "embedding")).withColumn("cosine", F.round("cosine", 5))


BUCKET = "(('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 8))::BIGINT % {1})"
_AT = BUCKET.format("p_partkey", "greatest(length(p_brand), 1)")


@query(f"""WITH t AS (SELECT p_partkey, p_brand, p_partkey % 50 = 0 AS hit, (p_partkey // 50) % 3 AS turn, {_AT} + 1 AS place FROM part)
 SELECT p_partkey, CASE WHEN hit AND turn = 0 THEN '' WHEN hit AND turn = 1 THEN substr(p_brand, 1, place) || substr(p_brand, place, 1) || substr(p_brand, place + 1)
  WHEN hit THEN substr(p_brand, 2, 1) || substr(p_brand, 1, 1) || substr(p_brand, 3) ELSE p_brand END AS p_brand FROM t""")
def corrupted_values(spark, d):
    """Blanked, doubled and swapped values among all."""
    return ar.corrupted(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand")


@query("WITH f AS (SELECT p_brand AS value, min(p_partkey) AS first_row FROM part GROUP BY 1) SELECT value, first_row, row_number() OVER (ORDER BY first_row, value) AS id FROM f")
def value_encoding(spark, d):
    return ar.encoded(ce.with_rows(table(spark, d, "part"), "p_partkey"), "p_brand")


@query("SELECT n_nationkey, 'The attribute n_name has the value ' || n_name || '. The attribute n_regionkey has the value ' || n_regionkey || '.' AS sentence FROM nation")
def row_sentences(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", ar.serialised(n, ["n_name", "n_regionkey"]).alias("sentence"))


@query("""WITH v AS (SELECT doc_id, quality, doc_id % 10 AS cluster FROM labels), n AS (SELECT cluster, quality, count(*) AS n FROM v GROUP BY 1, 2), b AS (SELECT cluster, quality AS spread FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, quality DESC) AS r FROM n) WHERE r = 1)
 SELECT doc_id, cluster, spread FROM v JOIN b USING (cluster)""")
def label_propagation(spark, d):
    v = table(spark, d, "labels").select("doc_id", "quality", F.pmod("doc_id", F.lit(10)).alias("cluster"))
    return ar.propagated(v, "cluster", "quality").select("doc_id", "cluster", "spread")


@query("""WITH p AS (SELECT s_suppkey AS a, s_nationkey AS va FROM supplier), j AS (SELECT p.a, p.va, min(q.a) AS b FROM p JOIN p q ON q.a > p.a AND q.va IS DISTINCT FROM p.va GROUP BY 1, 2)
 SELECT j.a, j.va, j.b, q.va AS vb FROM j JOIN p q ON q.a = j.b""")
def mismatched_pairs(spark, d):
    return ar.mismatched_pairs(table(spark, d, "supplier"), "s_suppkey", "s_nationkey")


@query("SELECT c_custkey, CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 16 AS BIGINT) AS bucket, round((c_custkey % 7) / 7, 9) AS share FROM customer")
def hash_buckets(spark, d):
    return table(spark, d, "customer").select("c_custkey", numeric.hash_bucket(F.col("c_custkey"), 16).alias("bucket"), F.round(numeric.modulo_share(F.col("c_custkey"), 7), 9).alias("share"))


@query("""WITH l AS (SELECT c_custkey, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1),
 j AS (SELECT c_custkey, coalesce(l.n, 0) AS n_left, coalesce(r.n, 0) AS n_right FROM l FULL JOIN r USING (c_custkey)) SELECT * FROM j WHERE n_left <> 1 OR n_right <> 1""")
def key_alignment(spark, d):
    """Customers whose key isn't met exactly once on either side: repeats and gaps."""
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return ev.key_check(table(spark, d, "customer").select("c_custkey"), right, "c_custkey")


@query("WITH r AS (SELECT p_type, p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part) SELECT * FROM r ORDER BY turn, p_brand LIMIT 24")
def round_robin_selection(spark, d):
    p = table(spark, d, "part").select("p_type", "p_brand", "p_partkey")
    return ce.round_robin(p, "p_brand", ["p_partkey"], 24).withColumn("turn", F.col("turn").cast("bigint"))


@query(f"""WITH t AS (SELECT 'documents' AS source, source AS raw FROM documents UNION ALL SELECT 'pages', url FROM pages UNION ALL SELECT 'conversations', text FROM conversations),
 s AS (SELECT source, CASE WHEN raw IS NULL OR trim(raw) = '' THEN '<empty>' ELSE regexp_replace(regexp_replace(regexp_replace({SHAPE.format("regexp_replace(raw, '[^ -~]', '', 'g')")}, 'D+', 'D', 'g'), 'A+', 'A', 'g'), 'S+', 'S', 'g') END AS shape, raw FROM t),
 c AS (SELECT source, shape, count(*) AS n, max(length(raw)) AS longest FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, shape) AS rank FROM c) SELECT * FROM r WHERE rank <= 20""")
def text_shape_profile(spark, d):
    """The commonest run shapes of whole texts (ASCII signs), by table."""
    named = lambda t, c: table(spark, d, t).select(F.lit(t).alias("source"), F.col(c).alias("raw"))
    rows = named("documents", "source").unionByName(named("pages", "url")).unionByName(named("conversations", "text"))
    shape = text.run_shape(F.regexp_replace("raw", "[^ -~]", ""))
    counts = rows.groupBy("source", F.when(F.trim("raw") == "", "<empty>").otherwise(shape).alias("shape")).agg(F.count("*").alias("n"), F.max(F.length("raw")).cast("bigint").alias("longest"))
    return ce.top(counts, ["source"], 20, ["shape"])
