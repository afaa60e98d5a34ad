"""Queries of the whole plan, of rules and their refinement, of files, and of
what profiles, labels and annotations are compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veracell.functions import text
from veracell.operators import annotations as an
from veracell.operators import archive as ar
from veracell.operators import cells as ce
from veracell.operators import dual as du
from veracell.operators import evaluate as ev
from veracell.operators import evidence as evi
from veracell.operators import inference as inf
from veracell.operators import profile as pr
from veracell.operators import relations as re_
from veracell.operators import repair as rp
from veracell.operators import rules as ru
from veracell.operators import semantics as se
from veracell.sources import readers, sinks

from .catalogue import (COLLAPSED, CUSTOMER_COLUMNS, MODES, PART_CELLS, PART_SQL, SIMILAR, _list, part_cells, query, table)
from .catalogue2 import (CLEAN, CONFIG, DIRTY, INTERCEPT, MISSING, OBS, ORDER_RULES, REPAIRS, RULE_SQL, SIGMOID, TRUTH, _gate_sql, _gated, _orders, _prf, seen, weighed)
from .detect import DetectConfig, detect, export
from .inputs import dirty_customer, dirty_part

# ---- the whole plan with a given calibration

WEIGHTS = {
    "value:missing:missing_token": 1.5, "cell:missing:missing_token": 1.25, "value:outlier:parse_failure": 0.75, "value:outlier:type_conflict": 0.5, "cell:outlier:cell_parse_failure": 1.0,
    "value:outlier:parser_success": 0.25, "value:outlier:rarity_high": 0.5, "value:pattern:regex_pass": 0.375, "value:pattern:rarity_high": 0.875, "cell:pattern:pattern_match": 0.625,
    "cell:pattern:pattern_mismatch": 2.0,
}
_WEIGHT = "CASE feature " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 0 END"
_SCALES = _gate_sql(lambda t: t).split(", g AS (")[1].split(" FROM obs)")[0]  # SELECT *, CASE ... END AS gate_scale
SCORED = OBS + f""", g AS ({_SCALES} FROM obs),
 gx AS (SELECT row_idx, col, source, polarity, hard, strength * gate_scale AS s, scope || ':' || family || ':' || source AS feature FROM g),
 gw AS (SELECT row_idx, col, sum({_WEIGHT} * CASE polarity WHEN 'dirty' THEN s ELSE -s END) AS w, bool_or(hard) AS hard FROM gx GROUP BY 1, 2),
 sc AS (SELECT cell.row_idx, cell.col, cell.raw, cell.sig, {INTERCEPT} + coalesce(w, 0) AS logit, coalesce(hard, false) AS hard FROM cell LEFT JOIN gw USING (row_idx, col)),
 sp AS (SELECT *, {SIGMOID.format('greatest(-30, least(30, logit))')} AS posterior FROM sc)"""
GIVEN = dict(columns=CONFIG.columns, kinds=CONFIG.kinds, archetypes=CONFIG.archetypes, patterns=CONFIG.patterns, weights=WEIGHTS, intercept=INTERCEPT)


@query(SCORED + """ SELECT row_idx, col AS "column", round(logit, 6) AS logit, round(posterior, 6) AS posterior, CASE WHEN posterior >= 0.2 THEN 'dirty' ELSE 'clean' END AS decision,
 CASE WHEN hard THEN 'hard_dirty' ELSE '' END AS hard_label FROM sp""")
def cell_scores(spark, d):
    """Every cell of the table with its score, decision and hard label."""
    c = detect(dirty_part(spark, d), DetectConfig(**GIVEN, threshold=0.2)).cells
    return c.select("row_idx", "column", F.round("logit", 6).alias("logit"), F.round("posterior", 6).alias("posterior"), "decision", "hard_label")


@query(SCORED + """, pr AS (SELECT col, sig, avg(posterior) AS p FROM sp GROUP BY 1, 2)
 SELECT sp.row_idx || '::' || sp.col AS cell_key, sp.row_idx AS row_index, sp.col AS "column", raw AS value, round(p, 6) AS value_prior, round(posterior, 6) AS cell_posterior,
  CASE WHEN posterior >= 0.5 THEN 'dirty' ELSE 'clean' END AS decision FROM sp JOIN pr USING (col, sig)""")
def score_rows(spark, d):
    """The score file's row of every cell, its best repair joined."""
    out = export(detect(dirty_part(spark, d), DetectConfig(**GIVEN)))
    return out.select("cell_key", "row_index", "column", "value", F.round("value_prior", 6).alias("value_prior"), F.round("cell_posterior", 6).alias("cell_posterior"), "decision")


@query(SCORED + f""", cx AS (SELECT gx.*, posterior, logit, posterior - {SIGMOID.format("greatest(-30, least(30, logit - " + _WEIGHT + " * CASE polarity WHEN 'dirty' THEN s ELSE -s END))")} AS c FROM gx JOIN sp USING (row_idx, col)),
 r AS (SELECT *, row_number() OVER (PARTITION BY row_idx, col ORDER BY round(c, 9) DESC, source) AS k FROM cx WHERE c > 1e-12 AND posterior >= 0.2)
 SELECT row_idx, col AS "column", source AS primary_reason FROM r WHERE k = 1""")
def primary_reasons(spark, d):
    """What weighs most in each suspicious cell."""
    found = detect(dirty_part(spark, d), DetectConfig(**GIVEN, threshold=0.2)).cells
    return found.where("decision = 'dirty' and primary_reason <> ''").select("row_idx", "column", "primary_reason")


@query(OBS + f', cw AS (SELECT row_idx, col, sum({_WEIGHT} * x) AS w FROM ft GROUP BY 1, 2) SELECT row_idx, col AS "column", round({SIGMOID.format(f"{INTERCEPT} + w")}, 6) AS posterior FROM cw')
def calibrated_posteriors(spark, d):
    """Scores under given weights, gates left out."""
    forms, obs = seen(spark, d)
    return forms.to_cells(inf.posteriors(inf.features(obs), INTERCEPT, WEIGHTS).select("row_idx", "column", F.round("posterior", 6).alias("posterior")))


@query(OBS + """, vx AS (SELECT row_idx, col, list_sort(list({'feature': feature, 'x': round(x, 3)}) FILTER (abs(x) > 1e-9)) AS v FROM ft GROUP BY 1, 2)
 SELECT CAST(len(v) AS BIGINT) AS n_features, count(*) AS n_cells, min(row_idx) AS first_row FROM vx GROUP BY v""")
def evidence_signatures(spark, d):
    """Distinct evidence vectors with their cells."""
    forms, obs = seen(spark, d)
    s = inf.signatures(forms.weighted(inf.evidence_vectors(inf.features(obs))))
    return s.select(F.size("vector").cast("bigint").alias("n_features"), F.col("n").alias("n_cells"), F.col("cell.row_idx").alias("first_row"))


@query(OBS + f""", vp AS (SELECT cell.col, sig, round(avg(coalesce(posterior, {SIGMOID.format("ln(0.05 / 0.95)")})), 6) AS prior, count(*) AS n FROM cell LEFT JOIN po ON cell.row_idx = po.row_idx AND cell.col = po.col GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, sig) AS rank FROM vp WHERE prior < 0.5) SELECT col AS "column", sig, n, rank FROM r WHERE rank <= 20""")
def seed_values(spark, d):
    """The commonest values that look clean."""
    forms, _, post = weighed(spark, d)
    return inf.seed_values(inf.value_priors(forms.rows, post, INTERCEPT))


# ---- gates, scales and promotion

_COUNTS = {("closed_enum", "pattern_mismatch"): (3, 1), ("numeric_measure", "rarity_high"): (2, 2)}


def _soft_sql():
    arms = []
    for c, a in CONFIG.archetypes.items():
        for s, target in zip(inf.GATED, inf.GATES[a]):
            clean, dirty = _COUNTS.get((a, s), (0, 0))
            arms.append(f"WHEN NOT hard AND col = '{c}' AND source = '{s}' THEN {1.0 if not clean else 1 - 0.8 * clean / (clean + dirty + 1.0) * (1 - target)!r}")
    return (OBS + f", g AS (SELECT *, CASE {' '.join(arms)} ELSE 1.0 END AS gate_scale FROM obs) SELECT row_idx, col AS \"column\", scope, source, "
            "round(strength * gate_scale, 6) AS strength, round(gate_scale, 6) AS gate_scale FROM g WHERE gate_scale < 1")


@query(_soft_sql())
def gate_soft(spark, d):
    return _gated(spark, d, mode="soft", support=_COUNTS, confidence={c: 0.8 for c in CONFIG.columns})


@query(OBS + f', g AS ({_SCALES} FROM obs) SELECT col AS "column", source, count(*) AS n, round(avg(strength), 6) AS before, round(avg(strength * gate_scale), 6) AS after FROM g WHERE gate_scale < 1 GROUP BY 1, 2')
def gate_summary(spark, d):
    forms, obs = seen(spark, d)
    return _prf(inf.gate_report(inf.gate(forms.weighted(obs), CONFIG.archetypes)))


@query(OBS + """ SELECT row_idx, col AS "column", source, round(CASE WHEN source IN ('pattern_match', 'pattern_mismatch') THEN strength * 0.5 ELSE strength END, 6) AS strength FROM obs WHERE scope = 'cell'""")
def scaled_rule_evidence(spark, d):
    forms, obs = seen(spark, d)
    return forms.to_cells(inf.scaled_rules(obs.where("scope = 'cell'"), 0.5).select("row_idx", "column", "source", F.round("strength", 6).alias("strength")))


BLANKED = "SELECT o_orderkey AS row_idx, CASE WHEN o_orderkey % 10 = 0 THEN 'N/A' WHEN o_orderkey % 1009 = 0 THEN '?' ELSE o_orderpriority END AS priority FROM orders"


def _blanked(spark, d):
    return spark.sql(BLANKED.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


_STRUCTURAL = f"""WITH s AS ({BLANKED}), v AS (SELECT {COLLAPSED.format('priority')} AS sig, count(*) AS n FROM s GROUP BY 1), t AS (SELECT count(*) AS total FROM s),
 m AS (SELECT row_idx, n >= 5 AND n / total >= 0.02 AS structural FROM s JOIN v ON {COLLAPSED.format('priority')} = sig, t WHERE sig IN ({_list(text.RULE_MISSING)}))"""


def _missing_evidence(spark, d):
    forms = ce.Forms(_blanked(spark, d), ["priority"])
    value = ce.values(forms.rows)
    specs = evi.infer_specs(value, forms.rows, {"priority": "categorical"}, {}, {}, {})
    return forms.to_cells(evi.cell_evidence(forms.rows, value, specs).where("source = 'missing_token'"))


@query(_STRUCTURAL + " SELECT row_idx, CASE WHEN structural THEN 0.15 ELSE 1.0 END AS strength, NOT structural AS hard FROM m")
def structural_missing(spark, d):
    """Missing tokens that are frequent weigh little and aren't hard."""
    return _missing_evidence(spark, d).select("row_idx", "strength", "hard")


@query(_STRUCTURAL + " SELECT row_idx, 1.0 AS strength, true AS hard FROM m")
def structural_promotion(spark, d):
    """The same where labels have shown that they are errors."""
    return inf.promote_structural(_missing_evidence(spark, d), ["priority"]).select("row_idx", "strength", "hard")


# ---- evidence of closed sets, prototypes, rules and relations

_LEGAL = ("brand#11", "brand#12", "brand#13", "brand#21")
_PROTO = ("Brand#11", "MEDIUM POLISHED")


def _spec(**k):
    return evi.ColumnSpec("p_brand", n_rows=1, **k)


@query(PART_CELLS + f""" SELECT row_idx, 1.0 AS strength, true AS hard FROM cell WHERE col = 'p_brand' AND NOT {MISSING} AND sig NOT IN ({_list(_LEGAL)})""")
def closed_set_evidence(spark, d):
    forms = ce.Forms(dirty_part(spark, d), ["p_brand"])
    out = evi.cell_evidence(forms.rows, ce.values(forms.rows), [_spec(legal=_LEGAL)])
    return forms.to_cells(out.where("source = 'closed_set_invalid'")).select("row_idx", "strength", "hard")


_NEAR = " UNION ALL ".join(f"SELECT sig, trim(raw) AS a, '{p}' AS b FROM v" for p in _PROTO)


@query(PART_CELLS + f""", v AS (SELECT sig, arg_min(raw, row_idx) AS raw FROM cell WHERE col = 'p_type' GROUP BY 1), p AS ({_NEAR}), s AS (SELECT sig, max({SIMILAR}) AS best FROM p GROUP BY 1)
 SELECT sig, CASE WHEN best >= 0.88 THEN 'prototype_close' ELSE 'prototype_far' END AS source, round(CASE WHEN best >= 0.88 THEN least(1.0, 0.4 + 0.6 * best) ELSE least(1.0, 0.85 - best) END, 6) AS strength FROM s WHERE best >= 0.88 OR best <= 0.35""")
def prototype_observations(spark, d):
    cell = part_cells(spark, d).where("column = 'p_type'")
    out = evi.value_evidence(ce.values(cell), [evi.ColumnSpec("p_type", n_rows=1, prototypes=_PROTO)])
    return out.where("family = 'prototype_lexical'").select("sig", "source", F.round("strength", 6).alias("strength"))


@query("SELECT o_orderkey AS row_idx, 4 AS evaluated, concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({s}) THEN '{r.name}' END" for r, s in zip(ORDER_RULES, RULE_SQL)) + ") AS failed, concat_ws(',', "
       + ", ".join(f"CASE WHEN {s} THEN '{r.name}' END" for r, s in zip(ORDER_RULES, RULE_SQL)) + ") AS passed, round(("
       + " + ".join(f"CAST({s} AS INTEGER)" for s in RULE_SQL) + ") / 4, 6) AS pass_ratio FROM orders")
def rule_provenance(spark, d):
    return ru.provenance(_orders(spark, d), ORDER_RULES).withColumn("pass_ratio", F.round("pass_ratio", 6))


_FORM = [ru.Rule("a", "o_orderpriority", "pattern", "lambda value, row=None: value[0:1] in ('1', '2', '3')"), ru.Rule("b", "o_orderpriority", "pattern", "lambda value, row=None: len(value) < 8"),
         ru.Rule("c", "o_orderpriority", "pattern", "lambda value, row=None: value.endswith('M')"), ru.Rule("d", "o_orderpriority", "pattern", "lambda value, row=None: '-' in value")]
_R = "((o_orderpriority[1] IN ('1', '2', '3'))::INT + (length(o_orderpriority) < 8)::INT + (o_orderpriority LIKE '%M')::INT + 1) / 4"


@query(f"""WITH r AS (SELECT o_orderkey AS row_idx, {_R} AS r FROM orders) SELECT row_idx, 'pattern_match' AS source, round(r, 6) AS strength FROM r WHERE r >= 0.75
 UNION ALL SELECT row_idx, 'pattern_mismatch', round(1 - r, 6) FROM r WHERE 1 - r >= 0.55""")
def pattern_rule_evidence(spark, d):
    """What the share of passed pattern rules says where a column has no pattern."""
    o = _orders(spark, d)
    cell = ce.cells(o, ["o_orderpriority"])
    c = cell.join(ce.values(cell).select("column", "sig", "support"), ["column", "sig"]).join(ru.pass_ratios(o, {"o_orderpriority": _FORM}), ["row_idx", "column"])
    out = evi.flat(evi.cell_arrays(c, [evi.ColumnSpec("o_orderpriority", n_rows=1)]))
    return out.where("family = 'pattern'").select("row_idx", "source", F.round("strength", 6).alias("strength"))


RELATED = ("SELECT c_custkey AS row_idx, CASE WHEN c_custkey % 11 = 0 THEN 'XX_metric' WHEN c_custkey % 13 = 0 THEN NULL ELSE concat(n_name, '_metric') END AS avg_code, "
           "n_name AS nation, CASE WHEN c_custkey % 7 = 0 THEN 'ZZ' ELSE substr(n_name, 1, 3) END AS head, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE r_name END AS region "
           "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")


def _related(spark, d):
    sql = RELATED.replace("FROM customer JOIN nation ", "FROM {customer} c JOIN {nation} n ").replace("JOIN region ", "JOIN {region} r ")
    return spark.sql(sql, **{t: table(spark, d, t) for t in ("customer", "nation", "region")})


_RELATIONS = {"avg_code": [("nation", "stateavg_format", 0.05), ("head", "prefix_match", 0.20), ("region", "contains", 0.50)]}


@query(f"""WITH s AS ({RELATED}), m AS (SELECT row_idx, lower(avg_code) AS v, lower(nation) AS n, lower(head) AS h, lower(region) AS r FROM s WHERE avg_code IS NOT NULL),
 k AS (SELECT row_idx, 2 + (r <> '')::INT AS a, (NOT starts_with(v, n || '_'))::INT AS st, (NOT starts_with(v, h))::INT + (r <> '' AND NOT contains(v, r))::INT AS w FROM m),
 e AS (SELECT row_idx, 'strong_relationship_violation' AS source, 'dirty' AS polarity, 1.0 AS strength, true AS hard FROM k WHERE st > 0
  UNION ALL SELECT row_idx, 'weak_relationship_violation', 'dirty', least(1.0, 0.35 + w / a), false FROM k WHERE st = 0 AND w > 0
  UNION ALL SELECT row_idx, 'relationship_satisfied', 'clean', 1.0, false FROM k WHERE st + w = 0
  UNION ALL SELECT row_idx, 'local_consistency_pass', 'clean', 0.75, false FROM k WHERE a >= 2 AND st + w = 0
  UNION ALL SELECT row_idx, 'local_consistency_fail', 'dirty', 0.75, false FROM k WHERE a >= 2 AND (st + w) / a >= 0.5) SELECT row_idx, source, polarity, round(strength, 6) AS strength, hard FROM e""")
def relation_observations(spark, d):
    out = evi.relation_evidence(_related(spark, d), "avg_code", _RELATIONS["avg_code"])
    return out.select("row_idx", "source", "polarity", F.round("strength", 6).alias("strength"), "hard")


_KINDS = {"stateavg_format": ("nation", "starts_with(v, o || '_')"), "prefix_match": ("head", "starts_with(v, o)"), "contains": ("region", "contains(v, o)"), "zip_prefix": ("nation", "left(v, 3) = left(o, 3)")}


@query(f"WITH s AS ({RELATED}), " + ", ".join(f"f_{k} AS (SELECT lower(avg_code) AS v, lower({c}) AS o FROM s WHERE avg_code IS NOT NULL AND {c} <> '')" for k, (c, _) in _KINDS.items())
       + " " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n_applicable, count(*) FILTER (NOT {h}) AS n_violations, round(count(*) FILTER (NOT {h}) / count(*), 9) AS violation_rate FROM f_{k}" for k, (_, h) in _KINDS.items()))
def relation_kinds(spark, d):
    """All four kinds of relation, profiled."""
    df, out = _related(spark, d), None
    for kind, (other, _) in _KINDS.items():
        one = re_.relation_profile(df, "avg_code", other, kind)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("violation_rate", F.round("violation_rate", 9))


_ORDER = "CASE ctx " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(CUSTOMER_COLUMNS)) + " END"
_GONE = f"('<na>', '<empty>', {_list(t for t in text.RULE_MISSING if t)})"


@query(MODES + f""", rel AS (SELECT md.*, mode_sig, predictiveness FROM md JOIN ms USING (ctx, tgt, ctx_sig) JOIN pred USING (ctx, tgt) WHERE predictiveness >= 0.20 AND g >= 3),
 met AS (SELECT pair.row_idx, ctx, tgt, mode_sig AS expected, pair.tgt_sig = mode_sig AS agrees, mode_n >= 3 AND mode_n / g >= 0.80 AS sound,
   ctx = 'region' AND tgt = 'nation' AND mode_n >= 2 AND mode_n > n AND mode_n / g >= 0.5 AS ruled, least(1.0, predictiveness * ln(g) / ln(1 + greatest((SELECT count(*) FROM src), 2))) AS base, n / g AS p
   FROM pair JOIN rel USING (ctx, tgt, ctx_sig) JOIN cnt USING (ctx, ctx_sig, tgt, tgt_sig) WHERE pair.tgt_sig NOT IN {_GONE}),
 ok AS (SELECT *, CASE WHEN agrees THEN 'clean' ELSE 'dirty' END AS polarity, base * CASE WHEN agrees THEN p ELSE 1 - p END AS strength FROM met WHERE CASE WHEN agrees THEN sound OR tgt = 'nationkey' ELSE sound OR ruled END),
 best AS (SELECT *, row_number() OVER (PARTITION BY row_idx, tgt, polarity ORDER BY round(strength, 12) DESC, {_ORDER}) AS r FROM ok)
 SELECT row_idx, tgt, polarity, ctx, expected, round(strength, 6) AS strength, NOT agrees AND ruled AND NOT sound AS rule FROM best WHERE r = 1""")
def identifier_and_rule_consensus(spark, d):
    """Consensus where identifiers agree on weaker support and an accepted
    dependency lets disagreements rest on less."""
    c = dirty_customer(spark, d)
    out = re_.consensus(c, CUSTOMER_COLUMNS, c.count(), frozenset({"nationkey"}), frozenset({("region", "nation")}))
    return out.select("row_idx", "tgt", "polarity", "ctx", "expected", F.round("strength", 6).alias("strength"), "rule")


# ---- rules that are made, and pairs of rules

_TOKENS = ("n/a", "?")


@query("""SELECT 'o_totalprice_complete' AS rule, count(*) AS n, CAST(0 AS BIGINT) AS n_violations FROM orders
 UNION ALL SELECT 'o_totalprice_range', count(*), count(*) FILTER (NOT (o_totalprice BETWEEN 1000 - 9950 AND 200000 + 9950)) FROM orders
 UNION ALL SELECT 'o_orderstatus_complete', count(*), CAST(0 AS BIGINT) FROM orders UNION ALL SELECT 'o_orderstatus_length', count(*), CAST(0 AS BIGINT) FROM orders
 UNION ALL SELECT 'o_orderpriority_length', count(*), count(*) FILTER (length(o_orderpriority) <> 8) FROM orders""")
def made_clean_rules(spark, d):
    """Completeness, ranges with room, length bands and fixed lengths."""
    rules = ru.fallback_rules("o_totalprice", "numeric", 1000.0, 200000.0, tokens=_TOKENS) + ru.fallback_rules("o_orderstatus", "categorical", lengths=(1, 1), tokens=_TOKENS)
    rules += ru.pattern_fallbacks("o_orderpriority", ["1-URGENT", "3-MEDIUM"])
    return ru.violation_rates(_orders(spark, d), rules).select("rule", "n", "n_violations")


@query("""SELECT 'o_totalprice_token' AS rule, count(*) AS n, CAST(0 AS BIGINT) AS n_violations FROM orders UNION ALL SELECT 'o_totalprice_large', count(*), count(*) FILTER (o_totalprice > 100000) FROM orders
 UNION ALL SELECT 'o_totalprice_negative', count(*), count(*) FILTER (o_totalprice < 0) FROM orders UNION ALL SELECT 'o_orderstatus_typo_1', count(*), count(*) FILTER (o_orderstatus IN ('P', 'X')) FROM orders
 UNION ALL SELECT 'o_orderstatus_typo', count(*), count(*) FILTER (o_orderstatus IN ('P', 'X')) FROM orders UNION ALL SELECT 'o_orderpriority_off_pattern', count(*), count(*) FILTER (NOT regexp_full_match(o_orderpriority, '[1-3]-.*')) FROM orders""")
def made_dirty_rules(spark, d):
    """Missing tokens, outliers, known typos and values off every pattern."""
    rules = ru.dirty_fallbacks("o_totalprice", 0.0, 200000.0, _TOKENS) + ru.typo_rules("o_orderstatus", ["P", "x"]) + ru.pattern_negation("o_orderpriority", ["[1-2]-.*", "3-.*"])
    return ru.violation_rates(_orders(spark, d), rules, clean=False).select("rule", "n", "n_violations")


@query(f"""WITH s AS ({RELATED}) SELECT 'avg_code_stateavg_format_nation' AS rule, count(*) AS n, count(*) FILTER (NOT starts_with(lower(avg_code), lower(nation) || '_')) AS n_violations FROM s
 UNION ALL SELECT 'avg_code_prefix_match_head', count(*), count(*) FILTER (NOT starts_with(lower(avg_code), lower(head))) FROM s
 UNION ALL SELECT 'avg_code_zip_prefix_nation', count(*), count(*) FILTER (left(avg_code, 3) <> left(nation, 3)) FROM s""")
def relation_rules(spark, d):
    """Rules of relations between columns, as text in the rule language."""
    rules = ru.relation_rules([("avg_code", "nation", "stateavg_format"), ("avg_code", "head", "prefix_match"), ("avg_code", "nation", "zip_prefix")])
    return ru.violation_rates(_related(spark, d), rules).select("rule", "n", "n_violations")


@query("""SELECT 'later_not_before_earlier' AS rule, count(*) AS n, count(*) FILTER (o_orderdate + INTERVAL (o_orderkey % 5 - 1) DAY < o_orderdate) AS n_violations FROM orders""")
def date_order_rule(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), day("o_orderdate").alias("earlier"),
                                         day(F.col("o_orderdate") + F.make_dt_interval((F.pmod("o_orderkey", F.lit(5)) - 1).cast("int"))).alias("later"))
    return ru.violation_rates(o, [ru.order_rule("earlier", "later")]).select("rule", "n", "n_violations")


_PROPOSED = {"o_totalprice": [("accuracy", ORDER_RULES[0].text), ("completeness", "lambda value, row=None: value is None"), ("stranger", "lambda value: True")],
             "o_orderstatus": [("pattern_consistency", ORDER_RULES[1].text), ("accuracy", "lambda value, row=None: value == 'never'"), ("accuracy", "lambda value, row=None: ...")]}


@query("""SELECT 'o_totalprice_accuracy_0' AS rule, 'outlier' AS family, CASE WHEN avg((o_totalprice BETWEEN 1000 AND 300000)::INT) < 0.5 THEN 'rejected' WHEN avg((o_totalprice BETWEEN 1000 AND 300000)::INT) = 1 THEN 'rejected' ELSE 'accepted' END AS verdict FROM orders
 UNION ALL SELECT 'o_totalprice_completeness_1', 'missing', 'accepted' UNION ALL SELECT 'o_orderstatus_pattern_consistency_0', 'pattern', CASE WHEN avg((o_orderstatus IN ('F', 'O'))::INT) < 0.5 OR avg((o_orderstatus IN ('F', 'O'))::INT) = 1 THEN 'rejected' ELSE 'accepted' END FROM orders
 UNION ALL SELECT 'o_orderstatus_accuracy_1', 'outlier', 'rejected' UNION ALL SELECT 'o_orderstatus_accuracy_2', 'outlier', 'rejected'""")
def rule_pool(spark, d):
    """Proposals by agent, judged together."""
    _, log = ru.rule_pool(_orders(spark, d), _PROPOSED)
    return spark.createDataFrame([(e["rule"], e["family"], "accepted" if e["verdict"] == "accepted" else "rejected") for e in log], "rule string, family string, verdict string")


_DUAL = {"o_totalprice": ru.dual_fallbacks("o_totalprice", "numeric", bound=150000.0), "o_orderstatus": ru.dual_fallbacks("o_orderstatus", "categorical", ("F", "O")),
         "o_orderpriority": (CLEAN[:1], DIRTY[:1])}


@query("""WITH z AS (SELECT 'o_totalprice' AS "column", o_totalprice <= 150000 AS c, o_totalprice > 150000 AS x FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus IN ('F', 'O'), o_orderstatus NOT IN ('F', 'O') FROM orders
  UNION ALL SELECT 'o_orderpriority', o_totalprice <= 250000, o_totalprice > 200000 FROM orders)
 SELECT "column", count(*) FILTER (c AND x) AS n_both, round(avg(c::INT), 9) AS clean_rate, round(avg(x::INT), 9) AS dirty_rate, round(avg((NOT c AND NOT x)::INT), 9) AS gap_rate, count(*) FILTER (c AND x) = 0 AS disjoint FROM z GROUP BY 1""")
def disjoint_rules(spark, d):
    """Made pairs of clean and dirty rules, and one that overlaps."""
    out = du.disjointness(_orders(spark, d), _DUAL)
    return out.select("column", "n_both", *[F.round(c, 9).alias(c) for c in ("clean_rate", "dirty_rate", "gap_rate")], "disjoint")


@query("""WITH z AS (SELECT *, o_totalprice <= 250000 AS a, o_orderstatus IN ('F', 'O') AS b, o_totalprice > 200000 OR o_orderstatus = 'P' AS x FROM orders), g AS (SELECT * FROM z WHERE NOT (a AND b) AND NOT x)
 SELECT 'in_range' AS rule, count(*) FILTER (NOT a) AS n_false FROM g UNION ALL SELECT 'final', count(*) FILTER (o_orderstatus <> 'F') FROM (SELECT * FROM z WHERE NOT (a AND o_orderstatus = 'F') AND NOT x)""")
def gap_rule_counts(spark, d):
    """How many grey rows each clean rule alone refuses."""
    strict = [CLEAN[0], ru.Rule("final", "o_orderstatus", "pattern", "lambda value, row=None: value == 'F'")]
    zoned = du.zones(_orders(spark, d), strict, DIRTY)
    return du.false_counts(zoned, strict, zoned.columns)


@query("""WITH z AS (SELECT o_totalprice <= 250000 AND o_orderstatus IN ('F', 'O') AS c, (o_totalprice > 200000 AND false) OR o_orderstatus = 'P' AS x FROM orders), t AS (SELECT count(*) AS n, count(*) FILTER (c AND x) AS cx, count(*) FILTER (NOT c AND NOT x) AS gr FROM z),
 b AS (SELECT o_totalprice <= 250000 AND o_orderstatus = 'F' AS c, o_orderstatus = 'P' AS x FROM orders), s AS (SELECT count(*) FILTER (NOT c AND NOT x) AS gr, count(*) AS n FROM b)
 SELECT 'before' AS stage, round(gr / n, 9) AS grey FROM s UNION ALL SELECT 'after', round(gr / n, 9) FROM t""")
def refined_pair(spark, d):
    """A clean rule that is too narrow, widened by the grey zone's own values."""
    clean = [CLEAN[0], ru.Rule("final", "o_orderstatus", "pattern", "lambda value, row=None: value == 'F'")]
    dirty, o = DIRTY[1:], _orders(spark, d)
    grey = lambda c, x: {r.zone: r.rate for r in du.four_zones(du.zones(o, c, x)).collect()}.get("grey", 0.0)
    before = grey(clean, dirty)
    new, _, _ = du.refine_pair(o, clean, dirty, "o_orderstatus", rounds=1)
    return spark.createDataFrame([("before", round(before, 9)), ("after", round(grey(new, dirty), 9))], "stage string, grey double")


# ---- labels, annotations, repairs

@query(OBS + TRUTH + f""", fx AS (SELECT lb.*, coalesce(posterior, 0) >= 0.2 AS f, CASE WHEN lb.col = 'p_size' AND dirty LIKE '% cm' THEN left(dirty, length(dirty) - 3) END AS fixed,
  CASE WHEN {MISSING.replace('raw', 'dirty')} THEN 'missing_value' WHEN regexp_full_match(coalesce(dirty, ''), '[0-9]+') = regexp_full_match(coalesce(clean, ''), '[0-9]+') AND length(dirty) = length(clean) THEN 'rule_violation' ELSE 'pattern_violation' END AS t
  FROM lb LEFT JOIN po ON po.row_idx = lb.row_idx AND po.col = lb.col WHERE label = 1)
 SELECT coalesce(t, '<all>') AS error_type, count(*) AS n, count(*) FILTER (f) AS found, round(count(*) FILTER (f) / count(*), 6) AS recall, count(fixed) AS n_repairs, count(*) FILTER (fixed = clean) AS n_right,
  round(CASE WHEN count(fixed) > 0 THEN count(*) FILTER (fixed = clean) / count(fixed) ELSE 0 END, 6) AS repair_accuracy FROM fx GROUP BY ROLLUP (t)""")
def annotation_metrics(spark, d):
    """Recall by type of error, and how many repairs are right."""
    df = dirty_part(spark, d)
    forms, _, post = weighed(spark, d)
    post = forms.rows.select("row_idx", "column").join(post, ["row_idx", "column"], "left")
    best = rp.candidates(df, REPAIRS[:1]).where("rank = 1").select("row_idx", "column", F.col("candidate").alias("repair"))
    t = forms.to_cells(post, ev.truth(df, CONFIG.clean).withColumn("raw", F.col("dirty"))).join(best, ["row_idx", "column"], "left")
    return _prf(ev.typed_metrics(t.withColumn("predicted", (F.coalesce("posterior", F.lit(0.0)) >= 0.2).cast("int"))))


@query(f"""WITH src AS ({PART_SQL}), t AS (SELECT row_idx, 'p_brand' AS col, p_brand AS a, clean_brand AS b FROM src UNION ALL SELECT row_idx, 'p_size', p_size, clean_size FROM src),
 w AS (SELECT *, CASE WHEN {MISSING.replace('raw', 'a')} THEN 'missing_value' ELSE 'pattern_violation' END AS error_type FROM t WHERE a IS DISTINCT FROM b),
 r AS (SELECT *, row_number() OVER (PARTITION BY col, error_type ORDER BY row_idx) AS k FROM w)
 SELECT col AS "column", error_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM src), 9) AS rate, string_agg(coalesce(a, '(null)') || ' -> ' || b, '; ' ORDER BY row_idx) FILTER (k <= 5) AS examples FROM r GROUP BY 1, 2""")
def column_error_analysis(spark, d):
    return ev.column_errors(ev.truth(dirty_part(spark, d), CONFIG.clean)).withColumn("rate", F.round("rate", 9))


@query(f"""WITH src AS ({PART_SQL}) SELECT count(*) AS n_rows, count(*) * 2 AS n_cells, CAST(sum((p_brand IS DISTINCT FROM clean_brand)::INT + (p_size IS DISTINCT FROM clean_size)::INT) AS BIGINT) AS n_differing FROM src""")
def preparation_report(spark, d):
    p = dirty_part(spark, d)
    clean = p.select("row_idx", F.col("clean_brand").alias("p_brand"), F.col("clean_size").alias("p_size"))
    return ev.preparation(p.select("row_idx", "p_brand", "p_size"), clean, "row_idx", ["p_brand", "p_size"])


@query(f"""WITH src AS ({PART_SQL}), n AS (SELECT row_idx, p_brand AS e, clean_brand AS r FROM src WHERE row_idx % 97 = 0 OR row_idx % 101 = 0)
 SELECT row_idx, 'p_brand' AS "column", true AS valid_key, true AS error_matches, true AS right_matches, false AS turned FROM n WHERE row_idx % 2 = 0
 UNION ALL SELECT row_idx, 'p_brand', true, lower(trim(r)) = lower(trim(e)), lower(trim(r)) = lower(trim(e)), lower(trim(r)) <> lower(trim(e)) FROM n WHERE row_idx % 2 = 1
 UNION ALL SELECT -1, 'p_brand', false, false, false, false""")
def aligned_annotations(spark, d):
    """Annotations against the tables: those of odd rows are the wrong way round, one has no row."""
    p = dirty_part(spark, d)
    n = p.where("row_idx % 97 = 0 or row_idx % 101 = 0").withColumn("odd", F.col("row_idx") % 2 == 1)
    notes = n.select("row_idx", F.lit("p_brand").alias("column"), F.when(F.col("odd"), F.col("clean_brand")).otherwise(F.col("p_brand")).alias("error_value"),
                     F.when(F.col("odd"), F.col("p_brand")).otherwise(F.col("clean_brand")).alias("right_value"))
    notes = notes.unionByName(spark.createDataFrame([(-1, "p_brand", "a", "b")], notes.schema))
    clean = p.select("row_idx", F.col("clean_brand").alias("p_brand"))
    return an.aligned(notes, p.select("row_idx", "p_brand"), clean, "row_idx", ["p_brand"]).drop("error_value", "right_value").na.fill(False)


@query("""WITH t AS (SELECT o_orderkey, 't1.' || 'o_custkey = t2.o_custkey & t1.o_totalprice <> t2.o_totalprice' AS c, '(' || o_orderkey || ', ' || (o_orderkey + 1) || ')' AS p FROM orders)
 SELECT o_orderkey, array_to_string(list_sort(list_distinct(regexp_extract_all(c, 't[12]\\.([A-Za-z_][A-Za-z0-9_]*)', 1))), ',') AS columns, list_sum(list_transform(regexp_extract_all(p, '([0-9]+)', 1), lambda x: CAST(x AS BIGINT)))::BIGINT AS total FROM t""")
def written_constraints(spark, d):
    """Columns and rows named in written constraints and tuple pairs."""
    o = table(spark, d, "orders").select("o_orderkey")
    pair = F.concat(F.lit("("), F.col("o_orderkey").cast("string"), F.lit(", "), (F.col("o_orderkey") + 1).cast("string"), F.lit(")"))
    constraint = F.lit("t1.o_custkey = t2.o_custkey & t1.o_totalprice <> t2.o_totalprice")
    return o.select("o_orderkey", F.array_join(an.determinants(constraint), ",").alias("columns"), F.aggregate(an.tuple_rows(pair), F.lit(0).cast("bigint"), lambda t, x: t + x).alias("total"))


_MOVED = "SELECT c_custkey AS row_idx, CASE WHEN c_custkey % 5 = 0 THEN concat('Town ', n_name) WHEN c_custkey % 5 = 1 THEN 'Old Town' ELSE 'Town' END AS city, n_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(f"""WITH s AS ({_MOVED}), t AS (SELECT row_idx, regexp_extract(trim(city), '^(.*\\S)\\s+\\S+$', 1) AS head, lower(regexp_extract(trim(city), '\\s(\\S+)$', 1)) AS tail FROM s)
 SELECT row_idx, head AS candidate FROM t WHERE tail IN (SELECT lower(state) FROM s) AND head <> ''""")
def trailing_token_repairs(spark, d):
    """A last word that is a value of another column is taken off."""
    sql = _MOVED.replace("FROM customer JOIN nation ", "FROM {customer} c JOIN {nation} n ")
    df = spark.sql(sql, customer=table(spark, d, "customer"), nation=table(spark, d, "nation"))
    return rp.candidates(df, [rp.Operation("split_trailing_token", "city", target="state")]).select("row_idx", "candidate")


@query("""SELECT 'strip_suffix' AS kind, 'ok' AS verdict UNION ALL SELECT 'regex_replace', 'no_match' UNION ALL SELECT 'truncate_at_marker', 'missing_argument' UNION ALL SELECT 'paint', 'unknown_operation' UNION ALL SELECT 'normalize_surface', 'low_confidence'""")
def repair_plan_verdicts(spark, d):
    """A plan's operations by form, reach and result."""
    ops = [REPAIRS[0], rp.Operation("regex_replace", "p_brand", pattern="zzz$"), rp.Operation("truncate_at_marker", "p_size"), rp.Operation("paint", "p_size"), rp.Operation("normalize_surface", "p_size", confidence=0.2, mapping={"a": "b"})]
    got = rp.validated(dirty_part(spark, d), ops, {"p_size": "[0-9]+"})
    return spark.createDataFrame([(op.kind, v) for op, v in got], "kind string, verdict string")


# ---- profiles

@query(PART_CELLS + f""", s AS (SELECT col, avg((regexp_full_match(trim(raw), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)'))::INT) AS parsed, count(DISTINCT sig) AS "distinct", count(*) AS n, avg(length(raw)) AS length,
  avg(CASE WHEN length(regexp_replace(raw, '\\s', '', 'g')) > 0 THEN length(regexp_replace(raw, '[^0-9]', '', 'g')) / length(regexp_replace(raw, '\\s', '', 'g')) ELSE 0 END) AS digits FROM cell WHERE raw IS NOT NULL GROUP BY 1)
 SELECT col AS "column", round(parsed, 6) AS parsed, round(digits, 6) AS digits, "distinct", n, round(length, 6) AS length,
  CASE WHEN parsed >= 0.8 AND digits >= 0.5 THEN 'numeric' WHEN "distinct" / n > 0.5 AND length > 30 THEN 'text' ELSE 'categorical' END AS kind FROM s""")
def coarse_types(spark, d):
    return _prf(pr.coarse_types(part_cells(spark, d)))


@query(PART_CELLS + """, v AS (SELECT col, sig, count(*) AS n, min(row_idx) AS first_row, arg_min(raw, row_idx) AS first_raw FROM cell WHERE sig <> '<na>' GROUP BY 1, 2), t AS (SELECT col, sum(n) AS total FROM v GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, first_row) AS rank FROM v) SELECT col AS "column", first_raw AS prototype, n, rank, round(sum(n) OVER (PARTITION BY col ORDER BY rank) / total, 9) AS coverage FROM r JOIN t USING (col) WHERE rank <= 10""")
def prototype_candidates(spark, d):
    """The ten commonest values of each column and what they cover together."""
    return pr.prototypes(ce.values(part_cells(spark, d))).withColumn("coverage", F.round("coverage", 9))


@query(PART_CELLS + """, b AS (SELECT * FROM cell WHERE raw IS NOT NULL AND col = 'p_size'), p AS (SELECT unnest(['\\d', '\\d{2}']) AS pattern)
 SELECT col AS "column", pattern, round(avg(regexp_full_match(trim(raw), pattern)::INT), 9) AS rate FROM b, p GROUP BY 1, 2 HAVING avg(regexp_full_match(trim(raw), pattern)::INT) >= 0.5""")
def regex_candidates(spark, d):
    """Patterns made of a column's commonest values, with the share they match."""
    cell = part_cells(spark, d).where("column = 'p_size'")
    return pr.regex_candidates(cell, ce.values(cell)).select("column", "pattern", F.round("rate", 9).alias("rate"))


@query("""WITH x AS (SELECT o_orderkey AS row_idx, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), t AS (SELECT count(*) AS n FROM orders)
 SELECT row_idx FROM x, t WHERE n <= 256 OR floor(i * 256 / n) <> floor((i - 1) * 256 / n)""")
def even_sample(spark, d):
    """Rows at even distances in the table's order."""
    return ar.evenly_placed(table(spark, d, "orders"), "o_orderkey", 256).select(F.col("o_orderkey").alias("row_idx"))


@query("SELECT s_nationkey, round(avg(s_acctbal), 6) AS mean, round(stddev_pop(s_acctbal), 6) AS std, count(*) AS n FROM supplier GROUP BY 1")
def column_score_summary(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("column"), F.col("s_acctbal").alias("score"))
    return _prf(ar.column_scores(s).withColumnRenamed("column", "s_nationkey"))


@query("""SELECT * FROM (VALUES ('zipcode', 'state', 'none'), ('stateavg', 'state', 'prefix_match'), ('stateavg', 'state', 'stateavg_format'), ('city_name', 'city', 'contains'), ('zip_code', 'zipcode', 'zip_prefix')) t("column", other, kind) WHERE kind <> 'none'""")
def named_relations(spark, d):
    """Relations that column names alone suggest."""
    return spark.createDataFrame(se.named_relations(["state", "city", "zipcode", "stateavg", "city_name", "zip_code"]), "column string, other string, kind string")


# ---- files and back

def _folder(spark) -> str:
    return f"{sinks.workspace(spark)}/files-{uuid.uuid4().hex}"


@query(f"SELECT CAST(row_idx AS VARCHAR) AS row_idx, p_name, CASE WHEN trim(p_brand) = '' THEN NULL ELSE trim(p_brand) END AS p_brand, p_size FROM ({PART_SQL})")
def csv_cells(spark, d):
    """A dirty table through a CSV file, read cell by cell."""
    at = _folder(spark)
    dirty_part(spark, d).select("row_idx", "p_name", "p_brand", "p_size").write.option("header", True).option("emptyValue", "").csv(at)
    return readers.read_csv(spark, at, sentinel=None, per_cell=True)


@query("SELECT p_partkey, p_size, p_retailprice, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END AS p_name FROM part")
def csv_types(spark, d):
    """Types inferred from a CSV file, the sentinel as null."""
    at = _folder(spark)
    name = F.when(F.col("p_partkey") % 9 == 0, "empty").otherwise(F.col("p_name"))
    table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", name.alias("p_name")).write.option("header", True).csv(at)
    out = readers.read_csv(spark, at)
    return out.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), F.col("p_size").cast("int").alias("p_size"), "p_retailprice", "p_name")


@query(SCORED + ' SELECT row_idx, col AS "column", round(posterior, 6) AS posterior FROM sp')
def score_file(spark, d):
    """Scores written in order and read back."""
    at = _folder(spark)
    sinks.write_scores(detect(dirty_part(spark, d), DetectConfig(**GIVEN)).posteriors, at)
    return spark.read.parquet(at).select("row_idx", "column", F.round("posterior", 6).alias("posterior"))


@query(SCORED + """ SELECT sp.row_idx AS row_index, sp.col AS "column", CASE WHEN posterior >= 0.5 THEN 'dirty' ELSE 'clean' END AS decision, CAST((SELECT count(*) FROM obs WHERE obs.row_idx = sp.row_idx AND obs.col = sp.col) AS BIGINT) AS n_evidence FROM sp""")
def trace_file(spark, d):
    """Explanation traces as JSON lines, read back with their evidence."""
    at = _folder(spark)
    c = detect(dirty_part(spark, d), DetectConfig(**GIVEN)).cells
    sinks.write_explanations(c.select(F.col("row_idx").alias("row_index"), "column", F.col("raw").alias("value"), "posterior", "decision", "evidence"), at)
    return readers.read_traces(spark, at).select("row_index", "column", "decision", F.coalesce(F.size("evidence"), F.lit(0)).cast("bigint").alias("n_evidence"))


@query(f"""WITH src AS ({PART_SQL}) SELECT row_idx || '::p_size' AS cell_key, 'strip_suffix' AS mechanism, trim(left(trim(p_size), length(trim(p_size)) - 3)) AS candidate FROM src WHERE trim(p_size) LIKE '% cm'""")
def repair_file(spark, d):
    at = _folder(spark)
    sinks.write_repairs(rp.candidates(dirty_part(spark, d), REPAIRS[:1]), at)
    return readers.read_csv(spark, at, strings=True).select("cell_key", "mechanism", "candidate")


@query("SELECT n_nationkey, round(0.5 + n_nationkey / 100, 4) AS precision, round(0.25 + n_nationkey / 100, 4) AS recall, round(0.125 + n_nationkey / 100, 4) AS f1 FROM nation")
def metric_logs(spark, d):
    """Metrics found in text logs, one for each nation."""
    at = _folder(spark)
    n = table(spark, d, "nation").select("n_nationkey")
    m = lambda b: F.format_string("%.4f", F.lit(b) + F.col("n_nationkey") / 100)
    n.select("n_nationkey", F.concat(F.lit("run "), F.col("n_nationkey"), F.lit("\nprecision="), m(0.5), F.lit(" recall="), m(0.25), F.lit("\nf1="), m(0.125)).alias("value")).repartition(25, "n_nationkey").write.partitionBy("n_nationkey").text(at)
    got = readers.read_metric_logs(spark, f"{at}/n_nationkey=*")
    return got.select(F.regexp_extract("file", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), "precision", "recall", "f1")
