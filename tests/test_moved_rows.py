"""What queries move between tasks: by distinct values, not by cells."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [
    "dopt_queries",
    "column_thresholds",
    "gate_summary",
    "evidence_coverage",
    "evidence_signatures",
    "gate_weak_prior",
    "hard_labels",
    "seed_values",
    "calibrated_posteriors",
    "detection_metrics",
    "loeo_contributions",
    "posterior_scores",
    "evidence_features",
    "threshold_sweep_f1",
    "value_priors",
    "per_column_metrics",
    "context_agreement",
    "identifier_and_rule_consensus",
    "calibrated_detection",
]
CUSTOMERS = ("context_agreement", "identifier_and_rule_consensus")


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Parts and customers many times, under shifted keys."""
    d = tmp_path_factory.mktemp("large")
    for t, key, times in (("part", "p_partkey", 100), ("customer", "c_custkey", 1000)):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        shifted = (F.col(key) + 1000 * F.col("id")).cast(df.schema[key].dataType)
        df.crossJoin(spark.range(times)).withColumn(key, shifted).drop("id").coalesce(2).write.parquet(f"{d}/{t}.parquet")
    for t in ("nation", "region"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    return str(d)


def moved(spark, run) -> int:
    """Records that a run writes to shuffles; only nations and regions are broadcast unasked."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(60_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        before = total()
        run()
        return total() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.catalog.clearCache()


@pytest.mark.parametrize("name", NAMES)
def test_cells_stay_where_they_are(spark, large, name):
    rows = spark.read.parquet(f"{large}/{'customer' if name in CUSTOMERS else 'part'}.parquet").count()
    assert moved(spark, lambda: entry.queries()[name](spark, large).write.format("noop").mode("overwrite").save()) < rows
