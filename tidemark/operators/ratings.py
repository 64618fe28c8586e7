"""Ratings by period: all games of a period are rated at once, from the ratings that held before it.

State crosses keys, so no window can say it. Every period is a superstep: its games meet the table of states (a row per
player) once for each side by an equality join, an aggregation gives each player's update, and the states are written
anew. What held before a period is kept for its players. Spark deals games and states by player; no task and no driver
holds a league.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ledger import dropped, stored

Q = math.log(10) / 400
START, DEVIATION, FLOOR = 1500.0, 350.0, 50.0
KEPT = ("rating", "deviation", "games", "decisive")


def spread(rd: Column) -> Column:
    return 1 / F.sqrt(1 + 3 * (Q * Q) * rd * rd / (math.pi * math.pi))


def expectation(rating: Column, other: Column, other_rd: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -spread(other_rd) * (rating - other) / 400))


def sides(games: DataFrame) -> DataFrame:
    """Each game from both sides: period, player, other, score. Games without a period or a side are left out; so is one against oneself."""
    known = games.where("period IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND score IS NOT NULL AND a <> b")
    one = known.select("period", F.col("a").alias("player"), F.col("b").alias("other"), F.col("score").cast("double").alias("score"))
    return one.unionByName(known.select("period", F.col("b").alias("player"), F.col("a").alias("other"), (1 - F.col("score")).cast("double").alias("score")))


def _fresh(prefix: str) -> list[Column]:
    first = {"rating": F.lit(START), "deviation": F.lit(DEVIATION), "games": F.lit(0).cast("long"), "decisive": F.lit(0).cast("long")}
    return [F.coalesce(F.col(f"{prefix}{c}"), first[c]).alias(f"{prefix}{c}") for c in KEPT]


def superstep(now: DataFrame, state: DataFrame) -> DataFrame:
    """One period: player, what held before (before_*), and what holds after it. now: player, other, score; state: player and KEPT."""
    named = lambda prefix, key: state.select(F.col("player").alias(key), *[F.col(c).alias(f"{prefix}{c}") for c in KEPT])
    met = now.join(named("other_", "other"), "other", "left").join(named("before_", "player"), "player", "left")
    met = met.select("player", "score", *_fresh("before_"), *_fresh("other_"))
    g, e = spread(F.col("other_deviation")), expectation(F.col("before_rating"), F.col("other_rating"), F.col("other_deviation"))
    held = [f"before_{c}" for c in KEPT]
    found = met.groupBy("player", *held).agg(F.sum(g * g * e * (1 - e)).alias("inverse"), F.sum(g * (F.col("score") - e)).alias("step"), F.count("*").alias("n"), F.count_if(F.col("score") != 0.5).alias("won_or_lost"))
    total = 1 / (F.col("before_deviation") * F.col("before_deviation")) + Q * Q * F.col("inverse")
    certain = F.greatest(F.lit(FLOOR), F.sqrt(1 / total))
    after = found.withColumn("deviation", certain).withColumn("rating", F.col("before_rating") + Q * F.col("deviation") * F.col("deviation") * F.col("step"))
    return after.select("player", *held, "rating", "deviation", (F.col("before_games") + F.col("n")).alias("games"), (F.col("before_decisive") + F.col("won_or_lost")).alias("decisive"))


def rate(games: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(before, after): what every player of a period held before it, with period; and the last state of all players.

    games: period, a, b, score (of a: 1, 0.5 or 0). `state` continues from an earlier result, for periods after it: the
    same as one run over all. A later game changes nothing that was given for earlier periods. Work is that of all games
    and, for every period, one pass over the states.
    """
    sided = stored(sides(games), "sides", by="period")
    kind = games.schema["a"].dataType.simpleString()
    if state is None:
        state = games.sparkSession.createDataFrame([], f"player {kind}, rating double, deviation double, games long, decisive long")
    parts: list[DataFrame] = []
    made = None
    for (period,) in sided.select("period").distinct().orderBy("period").collect():  # one number for each superstep
        step = stored(superstep(sided.where(F.col("period") == period).drop("period"), state), "superstep")
        parts.append(step.select(F.lit(period).cast(games.schema["period"].dataType).alias("period"), "player", *[f"before_{c}" for c in KEPT]))
        new = stored(state.join(step, "player", "left_anti").unionByName(step.select("player", *KEPT)), "ratings")
        if made is not None:
            dropped(made)
        state = made = new
    dropped(sided)
    if not parts:
        nothing = f"period {games.schema['period'].dataType.simpleString()}, player {kind}, before_rating double, before_deviation double, before_games long, before_decisive long"
        return games.sparkSession.createDataFrame([], nothing), state
    while len(parts) > 1:  # a balanced tree, so that the plan stays shallow
        parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    return parts[0], state
