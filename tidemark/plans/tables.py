"""The driver's tables in the roles that the operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUTOFF = "2024-01-16 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cutoff() -> Column:
    return F.lit(CUTOFF).cast("timestamp_ntz")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with two clocks: in force from ts, observed k minutes later."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", k.alias("k"), F.col("ts").alias("effective_at"), (F.col("ts") + F.make_dt_interval(mins=k)).alias("observed_at"))


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as bets: a total order, a price, a settlement by return flag, a unit profit."""
    price = 1 + F.col("l_quantity") / 10
    settlement = F.when(F.col("l_returnflag") == "A", "WIN").when(F.col("l_returnflag") == "N", "LOSS").otherwise("PUSH")
    profit = F.when(F.col("l_returnflag") == "A", price - 1).when(F.col("l_returnflag") == "N", -1.0).otherwise(0.0)
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(*keys, price.alias("price"), settlement.alias("settlement"), profit.alias("profit"), F.col("l_shipdate").alias("at"))


BETS_SQL = """bets AS (
  SELECT *, 1 + l_quantity / 10 AS price, CASE l_returnflag WHEN 'A' THEN 'WIN' WHEN 'N' THEN 'LOSS' ELSE 'PUSH' END AS settlement,
    CASE l_returnflag WHEN 'A' THEN l_quantity / 10 WHEN 'N' THEN -1.0 ELSE 0.0 END AS profit FROM lineitem
)"""
OBS_SQL = """obs AS (
  SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, ts AS effective_at,
    ts + to_minutes(CAST(json_extract_string(props, '$.k') AS INT)) AS observed_at FROM events
)"""
