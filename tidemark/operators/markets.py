"""From hazards to market probabilities: person periods, survival products, fine atoms, derived markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAUSES = ("ko_tko", "submission", "other_stoppage")


def person_periods(rows: DataFrame, last: Column, cause: Column) -> DataFrame:
    """A row per interval survived, and one for the interval of the cause: class is `continue` before the last."""
    out = rows.withColumn("interval", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return out.withColumn("class", F.when(F.col("interval") == last, cause).otherwise("continue"))


def survival(hazards: DataFrame, keys: list[str], interval: str, stop: str) -> DataFrame:
    """Per interval the chance to reach it and to end in it: a running product, folded exactly in order."""
    path = hazards.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(interval, stop))).alias("__h"))
    start = F.struct(F.lit(1.0).alias("s"), F.array().cast(f"array<struct<{interval}:int,reached:double,ended:double>>").alias("out"))

    def step(a: Column, h: Column) -> Column:
        new = F.struct(h[interval].cast("int").alias(interval), a["s"].alias("reached"), (a["s"] * h[stop]).alias("ended"))
        return F.struct((a["s"] * (1 - h[stop])).alias("s"), F.concat(a["out"], F.array(new)).alias("out"))

    done = path.select(*keys, F.aggregate("__h", start, step).alias("a"))
    return done.select(*keys, F.col("a.s").alias("survived"), F.inline("a.out"))


def atoms(spark, rounds: int) -> DataFrame:
    """The atom universe of a schedule: half rounds by side and cause, and three decisions."""
    finishes = spark.range(2 * rounds).select(F.col("id").cast("int").alias("interval"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side")).select("*", F.explode(F.array(*map(F.lit, CAUSES))).alias("cause"))
    named = finishes.select(F.concat_ws("_", "side", "cause", F.concat(F.lit("i"), F.col("interval"))).alias("atom"), "side", "cause", "interval")
    ends = spark.range(1).select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit(None))).alias("side")).select(F.coalesce(F.concat(F.col("side"), F.lit("_decision")), F.lit("draw")).alias("atom"), "side", F.lit("decision").alias("cause"), F.lit(None).cast("int").alias("interval"))
    return named.unionByName(ends)


def atom_list(rounds: int) -> list[tuple[str | None, str, int | None]]:
    """(side, cause, interval) of all atoms of a schedule, in the order that derive_row expects."""
    finishes = [(side, cause, k) for k in range(2 * rounds) for side in "ab" for cause in CAUSES]
    return finishes + [("a", "decision", None), ("b", "decision", None), (None, "decision", None)]


def _cells(side: str | None, cause: str, k: int | None) -> dict[str, str]:
    """The outcome of each family to which an atom belongs."""
    return {
        "moneyline": f"fighter_{side}" if side else "draw",
        "goes_distance": "goes_distance" if k is None else "inside_distance",
        "method": cause if side else "draw",
        "fighter_by_method": f"{side}_{cause}" if side else "draw",
        "exact_round": "distance" if k is None else f"round_{k // 2 + 1}",
        "totals_1.5": "under" if k is not None and k <= 2 else "over",
        "totals_2.5": "under" if k is not None and k <= 4 else "over",
    }


def derive_row(rows: DataFrame, keys: list[str], p: Column, rounds: int) -> DataFrame:
    """As derive, from one array of probabilities a row, in the order of atom_list: sums within the row, nothing is shuffled."""
    places: dict[tuple[str, str], list[int]] = {}
    for k, atom in enumerate(atom_list(rounds)):
        for cell in _cells(*atom).items():
            places.setdefault(cell, []).append(k)
    sums = [F.struct(F.lit(family).alias("family"), F.lit(outcome).alias("outcome"), sum((F.get("__p", k) for k in at[1:]), F.get("__p", at[0])).alias("probability")) for (family, outcome), at in places.items()]
    return rows.select(*keys, p.alias("__p")).select(*keys, F.inline(F.array(*sums)))


def derive(fine: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Market outcomes from atoms (side, cause, interval): long rows of family and outcome. Each atom feeds all families at once."""
    side, cause, k = F.col("side"), F.col("cause"), F.col("interval")
    early = k.isNotNull()
    cell = lambda family, outcome: F.struct(F.lit(family).alias("family"), outcome.alias("outcome"))
    cells = F.array(
        cell("moneyline", F.when(side.isNotNull(), F.concat(F.lit("fighter_"), side)).otherwise("draw")),
        cell("goes_distance", F.when(early, "inside_distance").otherwise("goes_distance")),
        cell("method", F.when(side.isNull(), "draw").otherwise(cause)),
        cell("fighter_by_method", F.when(side.isNull(), "draw").otherwise(F.concat_ws("_", side, cause))),
        cell("exact_round", F.when(early, F.concat(F.lit("round_"), (F.floor(k / 2) + 1).cast("string"))).otherwise("distance")),
        cell("totals_1.5", F.when(k <= 2, "under").otherwise("over")),
        cell("totals_2.5", F.when(k <= 4, "under").otherwise("over")),
    )
    return fine.select(*keys, p, F.inline(cells)).groupBy(*keys, "family", "outcome").agg(F.sum(p).alias("probability"))
