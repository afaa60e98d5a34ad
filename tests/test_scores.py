"""The plan as a whole, and what it is made of, against definitions in plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from veracell.operators import cells as ce
from veracell.operators import dual as du
from veracell.operators import evidence as evi
from veracell.operators import inference as inf
from veracell.operators import repair as rp
from veracell.operators import rules as ru
from veracell.operators import scores as sc
from veracell.plans import proposals
from veracell.plans.detect import DetectConfig, detect, export
from veracell.sources import readers, sinks

ROWS = ([(k, "Oslo", "NO", "10", "Oslo", "NO") for k in range(20)] + [(k, "Paris", "FR", "11", "Paris", "FR") for k in range(20, 40)]
        + [(40, "Oslo", "FR", "10", "Oslo", "NO"), (41, "", "NO", "999", "Oslo", "NO"), (42, "Oslo cm", "NO", "12", "Oslo", "NO"), (43, "Rome", "NO", "x", "Oslo", "NO")])


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "row_idx bigint, city string, code string, age string, c_city string, c_code string")


def config(**k):
    return DetectConfig(["city", "code", "age"], {"city": "categorical", "code": "categorical", "age": "numeric"}, {"city": "geo_name", "code": "closed_enum", "age": "numeric_measure"}, **k)


def test_every_cell_has_a_row_and_every_kind_of_evidence_speaks(table):
    rule = ru.Rule("upper", "code", "pattern", "lambda value, row=None: value.isupper()")
    found = detect(table, config(context=["city", "code"], clean={"city": "c_city", "code": "c_code"}, legal={"code": ("no", "fr")}, prototypes=2, relations={"code": [("city", "contains", 0.9)]},
                                 dependencies=frozenset({("city", "code")}), rules=[rule], repairs=[rp.Operation("strip_suffix", "city", suffix=" cm")], label_budget=6))
    cells = {(r.row_idx, r.column): r for r in found.cells.collect()}
    assert len(cells) == 3 * len(ROWS) and all(0 <= r.posterior <= 1 for r in cells.values())
    families = {e.family for r in cells.values() for e in r.evidence}
    assert {"missing", "outlier", "pattern", "contextual", "relationship", "canonicalization", "prototype_lexical"} <= families
    against = next(e for e in cells[40, "code"].evidence if e.source == "contextual_disagreement")
    assert against.detail == "expected no by city" and "(expected no by city)" in cells[40, "code"].explanation
    assert any(e.source == "canonicalization_strip_suffix" for e in cells[42, "city"].evidence)
    assert cells[41, "city"].hard_label == "hard_dirty" and "missing_token" in cells[41, "city"].hard_reasons
    assert set(found.labels) and all(t for t in (found.thresholds or {"a": 1}).values())
    for column, t in found.thresholds.items():
        assert all(r.threshold == pytest.approx(t) and (r.decision == "dirty") == (r.posterior >= t) for (_, c), r in cells.items() if c == column)
    out = export(found).collect()
    assert len(out) == len(cells) and out[0].__fields__[0] == "cell_key" and len(out[0]) == 31
    fixed = next(r for r in out if r.cell_key == "42::city")
    assert fixed.repair_candidate == "Oslo" and "Oslo cm" in fixed.natural_language_explanation
    found.close()


def test_scores_by_hand(table):
    found = detect(table, config(weights={"value:missing:missing_token": 2.0, "cell:outlier:cell_parse_failure": 1.5}, intercept=-1.0, gating_mode="soft"))
    got = {(r.row_idx, r.column): r for r in found.cells.collect()}
    for key, logit in {(41, "city"): 1.0, (43, "age"): 0.5, (0, "city"): -1.0}.items():
        assert got[key].logit == pytest.approx(logit) and got[key].posterior == pytest.approx(1 / (1 + math.exp(-logit)))
    gain = next(e.contribution for e in got[41, "city"].evidence if e.scope == "value" and e.source == "missing_token")
    assert gain == pytest.approx(1 / (1 + math.exp(-1)) - 1 / (1 + math.exp(1)))


def test_arrays_say_what_long_rows_say(table):
    cell = ce.cells(table, ["city", "code", "age"])
    value = ce.values(cell)
    kinds = {"city": "categorical", "code": "categorical", "age": "numeric"}
    specs = evi.infer_specs(value, cell, kinds, {}, {}, {})
    long = evi.strongest(evi.on_cells(cell, evi.value_evidence(value, specs), evi.cell_evidence(cell, value, specs)))
    found = detect(table, config(unit_weights=True))
    names = ["row_idx", "column", "scope", "source", "polarity", "strength", "hard"]
    plain = lambda df: sorted(map(str, df.where("source <> 'rarity_high' or column <> 'age'").select(*names).collect()))
    assert plain(long) == plain(found.observations)


def test_one_of_each_keeps_the_strongest(spark):
    rows = [(1, "a", [("cell", "s", "f", "dirty", x, h, None) for x, h in ((0.2, False), (0.7, False), (0.5, True))])]
    df = spark.createDataFrame(rows, "row_idx bigint, column string, obs array<struct<scope:string,source:string,family:string,polarity:string,strength:double,hard:boolean,detail:string>>")
    assert sorted((o.strength, o.hard) for o in sc.one_of_each(df).first().obs) == [(0.5, True), (0.7, False)]
    up = sc.promoted(spark.createDataFrame([(1, "a", [("cell", "missing_token", "missing", "dirty", 0.15, False, None)])], df.schema), ["a"]).first().obs[0]
    assert (up.strength, up.hard) == (1.0, True)
    with pytest.raises(ValueError):
        sc.rules_scaled(df, -1)


def test_queries_cover_structural_missing():
    kinds = {"a": "x", "b": "y", "c": "y"}
    assert inf.cover_structural([(1, "a")], 2, {"y": (9, "b")}, set(), kinds) == [(1, "a"), (9, "b")]
    assert inf.cover_structural([(1, "a"), (2, "b"), (3, "b")], 3, {"y": (9, "c")}, set(), kinds) == [(1, "a"), (2, "b"), (9, "c")]
    assert inf.cover_structural([(9, "c")], 1, {"y": (9, "c")}, {(9, "c")}, kinds) == [(9, "c")]
    assert inf.cover_structural([(1, "a")], 0, {"y": (9, "b")}, set(), kinds) == []


def test_labels_allow_gates_and_promote(spark):
    from pyspark.sql import Row

    o = lambda s, hard=False: Row(source=s, polarity="dirty", hard=hard)
    rows = [Row(column="a", sig=str(k), label=int(k == 3), obs=[o("rarity_high"), *([o("missing_token")] if k in (2, 3, 4) else [])]) for k in range(4)]
    allowed, counts = inf.supported_policies(rows, {"a": "closed_enum"})
    assert counts["closed_enum", "rarity_high"] == (3, 1) and ("closed_enum", "rarity_high") in allowed
    assert inf.promoted_columns(rows, {"a": "closed_enum"}) == [] and inf.promoted_columns(rows[3:], {"a": "closed_enum", "b": "closed_enum"}) == ["a", "b"]


def test_made_rules_are_in_the_language(spark):
    df = spark.createDataFrame([(1, "12345", "10", "A_x"), (2, "123456", "abc", "B_y"), (3, None, None, None)], "row_idx bigint, zip string, b string, c string")
    rules = ru.pattern_fallbacks("zip", []) + ru.typo_rules("b", ["ABC", "7"]) + ru.pattern_negation("b", [], ["10", "11"]) + ru.relation_rules([("c", "b", "stateavg_format")])
    out = {r.row_idx: r for r in ru.outputs(df, rules).collect()}
    assert [out[k].zip_postal for k in (1, 2, 3)] == [True, False, False]
    assert [out[k].b_typo_3 for k in (1, 2, 3)] == [False, True, False] and out[2].b_typo and out[2].b_off_digits and not out[1].b_off_digits
    assert out[3].c_stateavg_format_b and not out[1].c_stateavg_format_b
    clean, dirty = ru.dual_fallbacks("b", "numeric", bound=100.0)
    zones = {r.row_idx: r.zone for r in du.zones(df, clean, dirty).collect()}
    assert zones == {1: "clean", 2: "grey", 3: "dirty"}


@pytest.mark.parametrize("samples,kind", [(["12345"], "zip"), (["1234567890"], "phone"), (["12x45"], "damaged_code"), (["123", "12.5"], "short_code"), (["123456", "654321"], "digits:even"), (["a b"], "unclear"), ([], "none")])
def test_guesses(samples, kind):
    assert ru.guess_pattern(samples) == kind


def test_shown_is_cut():
    assert ru.shown("x" * 100) == "x" * 77 + "..." and ru.shown(5) == "5"


def test_gaps_and_conflicts_are_resolved(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["a"] * 8 + ["b"] * 4 + ["z"] * 2)], "row_idx bigint, v string")
    clean = [ru.Rule("known", "v", "pattern", "lambda value, row=None: value == 'a'")]
    dirty = [ru.Rule("bad", "v", "pattern", "lambda value, row=None: value in ('z', 'a')")]
    assert du.report(df, clean, dirty)["status"] == "reject_conflict"
    new_clean, new_dirty, log = du.refine_pair(df, clean, dirty, "v")
    after = du.report(df, new_clean, new_dirty)
    assert after["rates"].get("conflict", 0) == 0 and after["rates"].get("grey", 0) == 0 and any(e["taken"] for e in log)
    assert du.dirty_prior("numeric", 100, 50) == pytest.approx(0.5) and du.dirty_prior("text", 100, 0, 0.95) == pytest.approx(0.08)


def test_proposals_come_from_the_table_own_file_only(spark, tmp_path, table):
    cache = sinks.ProposalCache(str(tmp_path / "rules.json"), "rules")
    df = table.select("row_idx", "city", "age")
    pool, log, source = proposals.rule_pool(df, {"city": "categorical", "age": "numeric"}, cache)
    assert source == "fallback" and {r.family for r in pool["city"]} >= {"missing"} and log
    again, _, source = proposals.rule_pool(df, {"city": "categorical", "age": "numeric"}, cache)
    assert source == "file" and again == pool
    other = df.withColumn("city", F.upper("city"))
    assert proposals.rule_pool(other, {"city": "categorical", "age": "numeric"}, cache)[2] == "fallback"


def test_fingerprint_needs_an_order(spark, table):
    with pytest.raises(ValueError):
        ce.fingerprint(table.drop("row_idx"))
    a, b = ce.fingerprint(table).first(), ce.fingerprint(table.withColumn("row_idx", 43 - F.col("row_idx"))).first()
    assert a.n == b.n and a.sha256 != b.sha256


def test_numbers_follow_the_files_order(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = sorted(r.row_idx for r in ce.numbered(df).collect())
    assert got == list(range(1000)) and ce.numbered(df.limit(0)).count() == 0


def test_mock_sales(spark):
    rows = readers.mock_sales(spark, 50).collect()
    assert len({r.order_id for r in rows}) == 50 and all(1 <= r.quantity <= 20 and 5 <= r.price <= 500 for r in rows)
    assert rows == readers.mock_sales(spark, 50).collect()
