"""An extension: a stream of rows scored with a frozen calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veracell.operators import cells as ce
from veracell.operators import evidence as evi
from veracell.operators import inference as inf
from veracell.operators.evidence import ColumnSpec


def score_batch(df: DataFrame, columns: list[str], specs: list[ColumnSpec], support: DataFrame, intercept: float, weights: dict[str, float] | None) -> DataFrame:
    """Posteriors of a batch's cells against the profile's value supports; a value
    the profile never saw has the batch's own support."""
    cell = ce.cells(df, columns)
    own = ce.values(cell)
    known = support.select("column", "sig", F.col("support").alias("_s"))
    value = own.join(known, ["column", "sig"], "left").withColumn("support", F.coalesce("_s", "support")).drop("_s")
    obs = evi.strongest(evi.on_cells(cell, evi.value_evidence(value, specs), evi.cell_evidence(cell, value, specs)))
    return inf.posteriors(inf.features(obs), intercept, weights)


def score_stream(stream: DataFrame, out: str, checkpoint: str, columns: list[str], specs: list[ColumnSpec], support: DataFrame, intercept: float, weights: dict[str, float] | None) -> StreamingQuery:
    """Writes each micro-batch's scores under ``out/batch=<id>``: a batch that is
    run again overwrites itself, so every row is scored once."""

    def write(df: DataFrame, batch: int) -> None:
        score_batch(df, columns, specs, support, intercept, weights).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and tumbling window, late rows within the
    watermark included; the same on a stream and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
