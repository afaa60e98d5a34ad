import hashlib
import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from veracell.operators import cells as ce
from veracell.operators import evaluate as ev
from veracell.operators import evidence as evi
from veracell.operators import repair as rp
from veracell.plans import catalogue, catalogue2
from veracell.plans.detect import DetectConfig, detect
from veracell.sources import readers, sinks
from veracell.streaming import score

SF = "/root/testdata/sf0.001"


def test_detection_finds_planted_errors(spark):
    rows = [(i, f"B{i % 10:02d}", f"B{i % 10:02d}") for i in range(200)]
    rows[7], rows[50] = (7, "", "B07"), (50, "??", "B00")
    df = spark.createDataFrame(rows, "row_idx bigint, code string, clean string")
    found = detect(df, DetectConfig(["code"], {"code": "categorical"}, {"code": "identifier"}, {"code": "B[0-9]{2}"}, clean={"code": "clean"}))
    best = [r.row_idx for r in found.posteriors.orderBy(F.desc("posterior")).limit(2).collect()]
    assert sorted(best) == [7, 50] and set(found.labels.values()) == {0, 1}
    why = {r.row_idx: r.primary_reason for r in found.explanations.where("decision = 'dirty'").collect()}
    assert why.keys() <= {7, 50}


def test_truth_and_metrics(spark):
    df = spark.createDataFrame([(0, "a", "a"), (1, None, "n/a"), (2, "x", "y")], "row_idx bigint, v string, c string")
    t = ev.truth(df, {"v": "c"})
    assert [r.label for r in t.orderBy("row_idx").collect()] == [0, 0, 1]
    m = ev.metrics(t.withColumn("predicted", F.lit(1))).first()
    assert (m.tp, m.fp, m.fn) == (1, 2, 0)


def test_repair_forms(spark):
    bad = [rp.Operation("eval", "v"), rp.Operation("strip_suffix", "v", confidence=0.2, suffix="x"), rp.Operation("regex_replace", "v", pattern="(")]
    assert [rp.check(o) for o in bad] == ["unknown_operation", "low_confidence", "bad_pattern"]
    df = spark.createDataFrame([(0, "5 cm"), (1, "7"), (2, "austin tx"), (3, "tx")], "row_idx bigint, v string")
    got = {(r.row_idx, r.candidate) for r in rp.candidates(df, [rp.Operation("strip_suffix", "v", suffix=" cm"), rp.Operation("split_trailing_token", "v", target="v")]).collect()}
    assert got == {(0, "5"), (2, "austin")}
    assert dict((o.kind, s) for o, s in rp.validated(df, [rp.Operation("strip_suffix", "v", suffix=" cm")], {"v": "[0-9]+"})) == {"strip_suffix": "ok"}


def test_queries_and_oracles_agree_on_names(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(catalogue.QUERIES) > 60
    assert entry.entry(spark).limit(1).count() == 1


def test_cached_proposals_belong_to_one_table(spark, tmp_path):
    df = spark.createDataFrame([(0, "a")], "row_idx bigint, v string")
    mark = ce.fingerprint(df).first().sha256
    assert mark == ce.fingerprint(df.repartition(3)).first().sha256
    cache = sinks.ProposalCache(str(tmp_path / "c.json"), "rules")
    cache.save(["v"], mark, [{"rule": "x"}], budget=3)
    assert cache.load(["v"], mark, budget=3) == [{"rule": "x"}] and cache.load(["v"], "other", budget=3) is None and cache.load(["w"], mark, budget=3) is None


def test_csv_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿id,v\n1,empty\n2, x \n")
    df = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["id", "v"] and [r.v for r in df.orderBy("id").collect()] == [None, " x "]
    assert [r.row_idx for r in ce.numbered(df).orderBy("id").collect()] == [0, 1]
    sinks.write_explanations(spark.createDataFrame([(0, float("nan"), 0.5)], "row_idx bigint, posterior double, confidence double"), str(tmp_path / "e"))
    line = spark.read.text(str(tmp_path / "e")).first()[0]
    assert "confidence" not in json.loads(line)


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    df = spark.createDataFrame([(i, "A1" if i % 5 else "?") for i in range(20)], "row_idx bigint, v string")
    cell = ce.cells(df, ["v"])
    value = ce.values(cell)
    specs = evi.infer_specs(value, cell, {"v": "categorical"}, {"v": "[A-Z][0-9]"}, {}, {})
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = score.score_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["v"], specs, value, -1.0, None)
    q.awaitTermination(120)
    got = {r.row_idx: round(r.posterior, 9) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.row_idx: round(r.posterior, 9) for r in score.score_batch(df, ["v"], specs, value, -1.0, None).collect()}
    assert got == want and len(got) == 20


def test_evidence_of_relations(spark):
    df = spark.createDataFrame([(0, "CA_m", "CA"), (1, "CA_m", "TX"), (2, "NY_m", "NY")], "row_idx bigint, avg string, state string")
    o = {(r.row_idx, r.source): r for r in evi.relation_evidence(df, "avg", [("state", "stateavg_format", 0.05)]).collect()}
    assert o[1, "strong_relationship_violation"].hard and (0, "relationship_satisfied") in o


def test_table_fingerprint_reads_all_columns(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet")
    x = total = 0
    for row in part.collect():
        told = "\x1f".join("-" if v is None else f"={v}" for v in (*row, row.p_partkey))  # the key is the row's place
        h = int(hashlib.md5(told.encode()).hexdigest()[:15], 16)
        x, total = x ^ h, total + h
    schema = part.selectExpr("*", "p_partkey as row_idx").schema.simpleString()
    want = hashlib.sha256(f"{schema}|{part.count()}|{x}|{total}".encode()).hexdigest()
    got = entry.queries()["table_fingerprint"](spark, SF).collect()
    assert [(r.n, r.sha256) for r in got] == [(part.count(), want)]
    first = F.col("p_partkey") == part.agg(F.min("p_partkey")).first()[0]
    seen = {want}
    for k, c in enumerate(part.columns):
        change = F.when(first, F.concat(c, F.lit("!")) if dict(part.dtypes)[c] == "string" else F.col(c) + 1).otherwise(F.col(c)).cast(part.schema[c].dataType)
        part.withColumn(c, change).write.parquet(str(tmp_path / str(k) / "part.parquet"))
        seen.add(entry.queries()["table_fingerprint"](spark, str(tmp_path / str(k))).first().sha256)
    assert len(seen) == len(part.columns) + 1


def test_column_thresholds_use_all_labelled_rows(spark):
    rows, want = catalogue2.labelled(spark, SF).select("column", "posterior", "label").collect(), {}
    for c in {r.column for r in rows}:
        own = [r for r in rows if r.column == c]
        share = len(own) / (len(own) + 5)
        clean, dirty = max((r.posterior for r in own if r.label == 0), default=None), min((r.posterior for r in own if r.label == 1), default=None)
        at = (clean + dirty) / 2 if clean is not None and dirty is not None and clean < dirty else max(0.5, clean + 0.05) if clean is not None else min(0.5, dirty - 0.05)
        want[c] = (len(own), round(max(0.05, min(0.95, (1 - share) * 0.5 + share * at)), 5))
    got = {r.column: (r.n, round(r.threshold, 5)) for r in entry.queries()["column_thresholds"](spark, SF).collect()}
    assert got == want
