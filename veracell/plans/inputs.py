"""Dirty tables made from the star schema by key-based corruption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The same text is an expression in Spark and in the oracle's SQL.
BRAND = ("CASE WHEN p_partkey % 97 = 0 THEN '' WHEN p_partkey % 101 = 0 THEN concat(p_brand, 'x') "
         "WHEN p_partkey % 103 = 0 THEN 'N/A' WHEN p_partkey % 107 = 0 THEN NULL ELSE p_brand END")
SIZE = "CASE WHEN p_partkey % 89 = 0 THEN 'big' WHEN p_partkey % 83 = 0 THEN concat(CAST(p_size AS VARCHAR(20)), ' cm') ELSE CAST(p_size AS VARCHAR(20)) END"
NATION = "CASE WHEN c_custkey % 113 = 0 THEN 'ATLANTIS' WHEN c_custkey % 127 = 0 THEN '' ELSE n_name END"

PART_SQL = f"SELECT p_partkey AS row_idx, p_name, {BRAND} AS p_brand, p_type, {SIZE} AS p_size, p_brand AS clean_brand, CAST(p_size AS VARCHAR(20)) AS clean_size, p_retailprice FROM part"
CUSTOMER_SQL = (f"SELECT c_custkey AS row_idx, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR(20)) AS nationkey, {NATION} AS nation, n_name AS clean_nation, "
                "r_name AS region, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PART_SQL.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = CUSTOMER_SQL.replace("FROM customer JOIN nation ", "FROM {customer} c JOIN {nation} n ").replace("JOIN region ", "JOIN {region} r ")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in ("customer", "nation", "region")})
