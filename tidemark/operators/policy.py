"""One pick per bout: ordered gates with all reasons kept, ranking, demotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ledger import stored


def gate_reasons(gates: Sequence[tuple[str, Column]]) -> Column:
    """The names of the gates that fail, in their order; a gate that can't be told fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in gates]))


def primary(reasons: Column, precedence: Sequence[str]) -> Column:
    """The reason that comes first in the precedence."""
    return F.get(F.filter(F.array(*map(F.lit, precedence)), lambda r: F.array_contains(reasons, r)), 0)


def select_top(candidates: DataFrame, bout: str, order: Sequence[Column], state: str = "state") -> DataFrame:
    """Of the passing candidates of a bout the first by `order` stays confirmed_value, the others are demoted to price_target."""
    w = Window.partitionBy(bout, F.col(state) == "confirmed_value").orderBy(*order)
    ranked = candidates.withColumn("__r", F.row_number().over(w))
    mine = F.col(state) == "confirmed_value"
    return ranked.withColumns({"demoted": mine & (F.col("__r") > 1), state: F.when(mine & (F.col("__r") > 1), "price_target").otherwise(F.col(state))}).drop("__r")


def numbered(picks: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Dense numbers 1..n over all rows: ranks within ranges, moved by the counts of the ranges before. No single task holds all rows."""
    spread = picks.select("*").repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    spread = stored(spread, "ranked")
    before = spread.groupBy("__part").agg(F.count("*").alias("__c"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("__b", F.coalesce(F.sum("__c").over(w), F.lit(0)))  # a row for each partition
    local = Window.partitionBy("__part").orderBy(*order)
    return spread.withColumn("__r", F.row_number().over(local)).join(before.select("__part", "__b"), "__part").withColumn(out, (F.col("__r") + F.col("__b")).cast("long")).drop("__part", "__r", "__b")


def collapse(candidates: DataFrame, selection: Sequence[str], fingerprint: str, order: Sequence[str]) -> DataFrame:
    """One row per selection, the first by order; ambiguous if its rows differ in their fingerprint."""
    rest = [c for c in candidates.columns if c not in selection]
    out = candidates.groupBy(*selection).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__v"), (F.countDistinct(fingerprint) > 1).alias("ambiguous"))
    return out.select(*selection, "__v.*", "ambiguous")


def reason_histogram(rows: DataFrame, reasons: str, catalogue: Sequence[str]) -> DataFrame:
    """Counts of every reason of the catalogue, zero where none."""
    counted = rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    known = rows.sparkSession.createDataFrame([(r,) for r in catalogue], "reason string")
    return known.join(counted, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))
