"""Event blocks: expanding folds and block bootstrap. A block is drawn or split whole, never its rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import newton
from tidemark.operators.ledger import stored


def expanding_folds(cards: DataFrame, card: str, start: str, cutoff: str) -> DataFrame:
    """Each card is a test fold once; it trains on the other cards that started before its cutoff: test_card, n_train, last_train.

    Starts and cutoffs are one line of time, dealt by ranges; each task walks its range, and what the ranges before hold
    is a row for each of them.
    """
    starts = cards.where(F.col(start).isNotNull()).select(F.col(start).alias("at"), F.lit(1).alias("kind"), F.col(card).alias("card"))
    line = starts.unionByName(cards.where(F.col(cutoff).isNotNull()).select(F.col(cutoff).alias("at"), F.lit(0).alias("kind"), F.col(card).alias("card")))
    order = ["at", "kind", "card"]  # a cutoff comes before the starts at its time
    spread = stored(line.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "line")
    begun = F.when(F.col("kind") == 1, F.struct("at", "card"))
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = spread.groupBy("part").agg(F.sum("kind").alias("c"), F.max(begun).alias("top"))  # a row for each range
    ranges = ranges.select("part", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("more"), F.last("top", ignorenulls=True).over(earlier).alias("held"))
    walked = spread.withColumns({"n": F.coalesce(F.sum("kind").over(here), F.lit(0)), "last": F.last(begun, ignorenulls=True).over(here)}).join(F.broadcast(ranges), "part")
    walked = walked.select("card", "kind", (F.col("n") + F.col("more")).alias("n"), F.coalesce("last", "held").alias("last"))
    own = cards.select(F.col(card).alias("card"), (F.col(start) < F.col(cutoff)).alias("own"))
    out = own.join(walked.where("kind = 0").select("card", "n", "last"), "card", "left").join(walked.where("kind = 1").select("card", F.col("last.at").alias("before")), "card", "left")
    late = F.when(F.col("last.card") == F.col("card"), F.col("before")).otherwise(F.col("last.at"))
    return out.select(F.col("card").alias("test_card"), (F.coalesce("n", F.lit(0)) - F.coalesce(F.col("own"), F.lit(False)).cast("int")).cast("long").alias("n_train"), late.alias("last_train"))


def hashed_draws(blocks: DataFrame, place: str, n_blocks: int, replicates: int) -> DataFrame:
    """(rep, k, place): draw k of replicate rep, an md5 of `rep:k` modulo the number of blocks: the same on every engine and partition."""
    spark = blocks.sparkSession
    grid = spark.range(replicates * n_blocks).select(F.floor(F.col("id") / n_blocks).cast("int").alias("rep"), (F.col("id") % n_blocks).cast("int").alias("k"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long")
    return grid.withColumn(place, (number % n_blocks).cast("int"))


def bootstrap(blocks: DataFrame, place: str, n_blocks: int, replicates: int, statistic: Column) -> DataFrame:
    """statistic over each replicate; blocks holds each block's sums, so a replicate joins few rows, and a block drawn twice counts twice."""
    return hashed_draws(blocks, place, n_blocks, replicates).join(blocks, place).groupBy("rep").agg(statistic.alias("value"))


def refits(rows: DataFrame, place: str, n_blocks: int, replicates: int, features: Sequence[str], label: str, c: float = 1.0) -> DataFrame:
    """(rep, weights, n): a ridge fit for each replicate of `hashed_draws`, as if the rows of its blocks were copied as often as drawn.

    No row is copied: how often a block was drawn is its rows' weight, and one aggregation a step serves all replicates.
    The draws are n_blocks * replicates numbers, both parameters.
    """
    draws = np.zeros((n_blocks, replicates))
    for rep, _, at in hashed_draws(rows, place, n_blocks, replicates).collect():
        draws[at, rep] += 1
    theta, n = newton.fit_ridge(rows.select(place, label, *features), features, label, newton.drawn_weights(place, draws), replicates, c)
    return rows.sparkSession.createDataFrame([(k, t.tolist(), int(m)) for k, (t, m) in enumerate(zip(theta, n, strict=True))], "rep int, weights array<double>, n long")


def interval(values: DataFrame, value: str = "value", **more: Column) -> DataFrame:
    """Linear percentiles of the replicates, and more aggregates of them."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    found = values.agg(p.alias("p"), F.count(value).alias("n"), *[c.alias(k) for k, c in more.items()])
    return found.select(*[F.col("p")[k].alias(f"p{x:02d}") for k, x in enumerate((5, 25, 50, 75, 95))], "n", *more)


def leaks(train: DataFrame, test: DataFrame, card: str, observed: str, cutoff: str) -> DataFrame:
    """Training rows of the test card itself, or observed after its cutoff; must be empty."""
    t = test.select(F.col(card).alias("__card"), F.col(cutoff).alias("__cut"), "fold")
    return train.join(t, "fold").where((F.col(card) == F.col("__card")) | (F.col(observed) > F.col("__cut")))
