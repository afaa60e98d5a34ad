"""Tables, traces and logs into DataFrames."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, sentinel: str | None = "empty", strings: bool = False, columns: list[str] | None = None, per_cell: bool = False, limit: int | None = None) -> DataFrame:
    """A CSV file with a header; a byte order mark is skipped. Types are inferred
    unless ``strings``; a cell that is just the sentinel is null. ``per_cell``
    reads strings and nulls empty ones; ``limit`` is an asked-for row count."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"')
    if strings or per_cell:
        if columns:
            reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
        df = reader.option("inferSchema", False).csv(path)
    else:
        df = reader.option("inferSchema", True).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if sentinel is not None:
        df = df.select(*[F.when(F.col(f"`{c}`") == sentinel, None).otherwise(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
    if per_cell:
        df = df.select(*[F.nullif(F.trim(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
    return df if limit is None else df.limit(limit)


TRACE = "row_index bigint, column string, value string, posterior double, decision string, evidence array<struct<source:string,family:string,polarity:string,strength:double,contribution:double>>"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Explanation traces, a JSON object a line; lines that aren't are dropped."""
    return spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


METRIC = r"(?i)precision[=: ]+([0-9.]+).*?recall[=: ]+([0-9.]+).*?f1[=: ]+([0-9.]+)"


def read_metric_logs(spark: SparkSession, path: str) -> DataFrame:
    """file, precision, recall, f1 of the first metrics found in each log."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\s+", " ").alias("t"))
    return t.where(F.col("t").rlike(METRIC)).select("file", *[F.regexp_extract("t", METRIC, k).try_cast("double").alias(n) for k, n in ((1, "precision"), (2, "recall"), (3, "f1"))])


def column_types(csv_path: str) -> dict[str, str]:
    """Declared column types beside a file: <file>.config.json or <dir>/<name>_config.json."""
    folder, name = os.path.split(csv_path)
    for p in (csv_path + ".config.json", os.path.join(folder, name.split("_")[0].removesuffix(".csv") + "_config.json")):
        if os.path.exists(p):
            with open(p) as f:
                return dict(json.load(f).get("col_type", {}))
    return {}


def renamed(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    for old, new in aliases.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def mock_employees(spark: SparkSession, n: int) -> DataFrame:
    """Rows of a made-up staff table, the same for the same n."""
    pick = lambda salt, items: F.element_at(F.array(*map(F.lit, items)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(items))) + 1).cast("int"))
    num = lambda salt, lo, hi: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(hi - lo)) + lo).cast("int")
    return spark.range(n).select((F.col("id") + 1).alias("employee_id"), pick(1, ["Ana", "Ben", "Chloe", "Dev", "Elif"]).alias("name"), num(2, 20, 65).alias("age"), pick(3, ["Sales", "Research", "Support"]).alias("department"),
                                 num(4, 30000, 120000).alias("salary"), pick(5, ["Lyon", "Oslo", "Porto", "Quito"]).alias("city"))


def mock_sales(spark: SparkSession, n: int) -> DataFrame:
    """Rows of a made-up order table, the same for the same n."""
    pick = lambda salt, items: F.element_at(F.array(*map(F.lit, items)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(items))) + 1).cast("int"))
    share = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10_000)) / 10_000
    return spark.range(n).select(
        F.format_string("ORD%06d", F.col("id") + 1).alias("order_id"), pick(6, ["Lamp", "Chair", "Desk", "Shelf"]).alias("product"), (1 + F.floor(share(7) * 20)).cast("int").alias("quantity"),
        F.round(5 + share(8) * 495, 2).alias("price"), pick(9, ["North", "South", "East", "West"]).alias("region"),
        F.date_format(F.date_add(F.lit("2024-01-01"), F.floor(share(10) * 366).cast("int")), "yyyy-MM-dd").alias("date"))


def row_texts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row's twin as sentences."""
    from veracell.operators.archive import serialised

    return df.select(key, serialised(df, columns).alias("text"))
