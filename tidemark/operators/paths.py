"""Ordered folds over bets: equity, drawdown, losing runs, bankroll. Each is per key, in a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flat_drawdown(bets: DataFrame, keys: Sequence[str], order: Sequence[str], profit: str) -> DataFrame:
    """Final equity and the deepest fall below its running peak, which starts at 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = bets.withColumn("__e", F.sum(profit).over(w))
    out = out.withColumn("__fall", F.greatest(F.lit(0.0), F.max("__e").over(w)) - F.col("__e"))
    return out.groupBy(*keys).agg(F.sum(profit).alias("equity"), F.max("__fall").alias("max_drawdown"), F.count("*").alias("bets"))


def losing_runs(bets: DataFrame, keys: Sequence[str], order: Sequence[str], settlement: str) -> DataFrame:
    """The longest run of losses; unresolved bets are passed over, all others end a run."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = bets.where(F.col(settlement) != "UNRESOLVED").withColumn("__island", F.count_if(F.col(settlement) != "LOSS").over(w))
    runs = out.groupBy(*keys, "__island").agg(F.count_if(F.col(settlement) == "LOSS").alias("__n"))
    return runs.groupBy(*keys).agg(F.max("__n").alias("longest_losing_run"))


def kelly_bankroll(bets: DataFrame, keys: Sequence[str], card: str, card_order: str, share: Column, payoff: Column) -> DataFrame:
    """All bets of a card stake from the bankroll at its start; the product over cards, and the deepest fall from the peak as a share of it.

    The product is a running sum of logarithms; a card that loses all ends the bankroll at 0. A key's cards pass one task
    in order, without being held.
    """
    cards = bets.groupBy(*keys, card).agg(F.min(card_order).alias("__o"), F.sum(share * payoff).alias("__r"))
    w = Window.partitionBy(*keys).orderBy("__o", card).rowsBetween(Window.unboundedPreceding, 0)
    rate = 1 + F.col("__r")
    grown = F.exp(F.sum(F.when(rate != 0, F.log(F.abs(rate)))).over(w)) * F.when(F.count_if(rate < 0).over(w) % 2 == 1, -1.0).otherwise(1.0)
    path = cards.withColumn("__b", F.when(F.count_if(rate == 0).over(w) > 0, 0.0).otherwise(grown)).withColumn("__peak", F.greatest(F.lit(1.0), F.max("__b").over(w)))
    return path.groupBy(*keys).agg(F.max_by("__b", F.struct("__o", card)).alias("bankroll"), F.max((F.col("__peak") - F.col("__b")) / F.col("__peak")).alias("max_drawdown"))


def running(bets: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    return bets.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
