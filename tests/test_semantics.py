import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veracell.operators import annotations as an
from veracell.operators import archive as ar
from veracell.operators import semantics as se

BASE = {"scope": "cross_row", "type": "functional_dependency", "determinant_columns": ["flight"], "dependent_column": "dep", "determinant_granularity": "instance", "dependent_variability": "invariant"}


@pytest.mark.parametrize("change,reason", [({}, "accepted"), ({"dependent_column": "flight"}, "same_determinant_and_dependent"), ({"type": "inclusion"}, "unsupported_type"), ({"scope": "row"}, "unsupported_scope"),
                                           ({"determinant_granularity": "recurring_entity", "dependent_variability": "instance_varying"}, "instance_varying_dependent_requires_instance_key"),
                                           ({"determinant_granularity": "recurring_entity"}, "accepted"), ({"dependent_column": "gate"}, "not_a_statistically_viable_candidate"), ({"dependent_column": "no"}, "unknown_column"),
                                           ({"determinant_granularity": "unknown"}, "ambiguous_semantic_granularity"), ({"determinant_columns": []}, "requires_one_determinant_column")])
def test_dependency_proposals(change, reason):
    assert se.judge_dependency({**BASE, **change}, ["flight", "dep", "gate"], {("flight", "dep")}) == reason


def test_low_support_dependency_speaks_and_ties_do_not(spark):
    rows = [(i, f, t) for i, (f, t) in enumerate([("A", "09:00"), ("A", "09:00"), ("A", "09:10"), ("A", "09:20")] + [("B", "10:00")] * 4)]
    df = spark.createDataFrame(rows, "row_idx bigint, flight string, dep string")
    got = {r.row_idx: r for r in se.dependency_disagreement(df, "flight", "dep").collect()}
    assert set(got) == {2, 3} and got[2].expected == "09:00" and 0 < got[2].strength < 1
    tie = spark.createDataFrame([(0, "A", "x"), (1, "A", "x"), (2, "A", "y"), (3, "A", "y"), (4, "B", "z")], "row_idx bigint, flight string, dep string")
    assert se.dependency_disagreement(tie, "flight", "dep").count() == 0


def test_names_suggest_relations():
    assert ("StateAvg", "State", "stateavg_format") in se.named_relations(["State", "StateAvg", "x"])
    assert se.archetype("ounces", "numeric").archetype == "unit_measure" and se.archetype("beer_name", "text").archetype == "open_entity"


def test_patterns_cover_a_column(spark):
    df = spark.createDataFrame([(f"A-{k:03d}",) for k in range(60)] + [(f"{k:05d}",) for k in range(38)] + [("??",), (None,)], "v string")
    found = dict(se.explore_patterns(df, "v"))
    assert set(found) == {r"[A-Za-z]\-\d{3}", r"\d{5}"}
    assert "fullmatch" in se.pattern_rule(list(found.items()))


def test_normalised(spark):
    df = spark.createDataFrame([(v,) for v in ["+1.50", "007", "1.0", "NaN", " Ab ", None, "0.0"]], "v string")
    assert [r[0] for r in df.select(an.normalised(F.col("v"))).collect()] == ["1.5", "7", "1", "<NA>", "ab", "<NA>", "0"]


def test_alignment_turns_swapped_values(spark):
    notes = spark.createDataFrame([("r1", "v", "bad", "good"), ("r2", "v", "good", "bad"), ("r9", "v", "a", "b")], "row_id string, column string, error_value string, right_value string")
    dirty = spark.createDataFrame([("r1", "bad"), ("r2", "bad")], "row_id string, v string")
    clean = spark.createDataFrame([("r1", "good"), ("r2", "good")], "row_id string, v string")
    got = {r.row_id: r for r in an.aligned(notes, dirty, clean, "row_id", ["v"]).collect()}
    assert got["r1"].error_matches and not got["r1"].turned and got["r2"].turned and not got["r9"].valid_key


def test_written_constraints(spark):
    r = spark.createDataFrame([("t1.zip = t2.zip & t1.city != t2.city", "[(3, 14)]")], "c string, p string").select(an.determinants(F.col("c")), an.tuple_rows(F.col("p"))).first()
    assert r[0] == ["city", "zip"] and r[1] == [3, 14]


def test_corruption_is_the_same_every_time(spark):
    df = spark.range(400).select(F.col("id").alias("k"), F.concat(F.lit("value"), "id").alias("v"))
    one, two = (ar.corrupted(df, "k", "v", 10).orderBy("k").collect() for _ in range(2))
    changed = [r.k for r in one if r.v != f"value{r.k}"]
    assert one == two and len(changed) == 40 and one[0].v == "" and one[20].v.startswith("av") and len(one[10].v) == len("value10") + 1


def test_neighbours(spark):
    v = spark.createDataFrame([(k, [float(k % 3 == j) + 0.01 * k for j in range(3)]) for k in range(30)], "vec_id bigint, embedding array<double>")
    a = {(r.vec_id, r["rank"]): r.other_id for r in ar.cosine_topk(v, 3, block=7).collect()}
    b = {(r.vec_id, r["rank"]): r.other_id for r in ar.cosine_topk(v, 3, block=100).collect()}
    assert a == b and len(a) == 90 and all(x != y for (x, _), y in a.items())


def test_em_tells_good_rules_from_bad(spark):
    rows = [(True, True)] * 90 + [(False, False)] * 8 + [(True, False)] * 2
    w = {r.rule: r for r in ar.em_weights(spark.createDataFrame(rows, "a boolean, b boolean"), ["a", "b"]).collect()}
    assert w["a"].pass_clean > 0.9 > w["a"].pass_dirty


def next_differing(rows, shift=1):
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    found = ((a, next((b for b in rows[i + shift :] if b[1] != a[1]), None)) for i, a in enumerate(rows))
    return sorted((*a, *b) for a, b in found if b)


@pytest.mark.parametrize("shift", [1, 3])
@pytest.mark.parametrize("block_rows", [7, 4096])
def test_mismatched_pairs_cross_blocks(spark, block_rows, shift):
    r = random.Random(4)
    sparse = [(k * 5000, r.randrange(1, 4)) for k in range(60)]
    hot = [(10**6 + k, 9) for k in range(50)]
    rest = [(2 * 10**6 + k, r.randrange(1, 9)) for k in range(60)] + [(2 * 10**6 + 30, 9), (None, 1), (3 * 10**6, None), (3 * 10**6 + 1, None), (4 * 10**6, 2), (4 * 10**6 + 9, 2)]
    rows = sparse + hot + rest
    r.shuffle(rows)
    got = ar.mismatched_pairs(spark.createDataFrame(rows, "k bigint, v bigint").repartition(3), "k", "v", shift, block_rows)
    text = lambda x: sorted(map(str, x))
    want = next_differing(rows, shift)
    assert len(want) > 100 and text(tuple(x) for x in got.collect()) == text(want)


def test_mismatched_pairs_query_is_whole(spark):
    import __spark_entry__ as entry

    s = spark.read.parquet("/root/testdata/sf0.1/supplier.parquet").select("s_suppkey", "s_nationkey").collect()
    got = entry.queries()["mismatched_pairs"](spark, "/root/testdata/sf0.1").collect()
    assert sorted(map(tuple, got)) == next_differing([tuple(x) for x in s])


def test_corrupted_values_query_is_whole(spark):
    import __spark_entry__ as entry

    def wrong(k, v):
        if k % 50:
            return v
        at = int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % max(len(v), 1) + 1
        return ("", v[:at] + v[at - 1] + v[at:], v[1::-1] + v[2:])[k // 50 % 3]

    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey", "p_brand").collect()
    got = entry.queries()["corrupted_values"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted((k, wrong(k, v)) for k, v in part) and sum(k % 150 == 50 for k, _ in got) > 5
