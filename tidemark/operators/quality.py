"""Source quality: tiers, best observations, gates, conflicts, reconstruction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECT = ("direct", "revision")
TIME_RANK = {"direct": 3, "revision": 2, "publication_proxy": 1}
TIER_RANK = {"gold": 4, "silver": 3, "bronze": 2, "conflict": 1}


def rank_of(value: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), value), F.lit(0))


def source_tiers(rows: DataFrame, keys: Sequence[str], kind: str = "version_kind", result: str = "result", winner: str = "winner", quality: str = "timestamp_quality", tier: str = "quality_tier") -> DataFrame:
    """Per key: conflict (any such row, or several results within a kind), else gold with a direct clock, else bronze; missing without results."""
    facts = rows.where(F.col(result).isNotNull())
    outcome = F.struct(F.col(result), F.when(F.col(result) == "win", F.col(winner)))
    per = facts.groupBy(*keys, kind).agg((F.countDistinct(outcome) > 1).alias("__x"), F.bool_or(F.coalesce(F.col(tier) == "conflict", F.lit(False))).alias("__c"), F.bool_or(F.coalesce(F.col(quality).isin(*DIRECT), F.lit(False))).alias("__d"))
    found = per.groupBy(*keys).agg(F.when(F.bool_or(F.col("__x") | F.col("__c")), "conflict").when(F.bool_or("__d"), "gold").otherwise("bronze").alias("tier"))
    return rows.select(*keys).distinct().join(found, list(keys), "left").withColumn("tier", F.coalesce("tier", F.lit("missing")))


def overall_tiers(rows: DataFrame, keys: Sequence[str], family: Column, kind: str = "version_kind", result: str = "result", quality: str = "timestamp_quality") -> DataFrame:
    """Families that disagree within a kind are a conflict; then gold for a direct clock, silver for two families, bronze."""
    f = rows.where(F.col(result).isNotNull()).withColumn("__f", family)
    per = f.groupBy(*keys, kind).agg((F.countDistinct(result) > 1).alias("__x"), F.bool_or(F.coalesce(F.col(quality).isin(*DIRECT), F.lit(False))).alias("__d"), F.collect_set("__f").alias("__fs"))
    out = per.groupBy(*keys).agg(F.bool_or("__x").alias("__x"), F.bool_or("__d").alias("__d"), F.size(F.array_distinct(F.flatten(F.collect_list("__fs")))).cast("long").alias("families"))
    return out.select(*keys, "families", F.when(F.col("__x"), "conflict").when(F.col("__d"), "gold").when(F.col("families") >= 2, "silver").otherwise("bronze").alias("tier"))


def best_observation(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The least row of each key by `order`, which ends in a unique column."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])).alias("__v")).select(*keys, "__v.*")


def conflicts(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Keys with several values: how many, the first and the last by order."""
    g = rows.groupBy(*keys).agg(F.countDistinct(value).alias("n_values"), F.min_by(value, F.struct(*order)).alias("first"), F.max_by(value, F.struct(*order)).alias("last"))
    return g.where("n_values > 1")


def gates(rows: DataFrame, specs: Sequence[tuple[str, Column, Column, float]]) -> DataFrame:
    """A row per gate (code, numerator, denominator, threshold): pass, fail, or insufficient without a denominator. One pass over the rows."""
    parts = [F.struct(F.lit(code).alias("code"), F.count_if(hit & among).alias("numerator"), F.count_if(among).alias("denominator"), F.lit(float(t)).alias("threshold")) for code, hit, among, t in specs]
    out = rows.agg(F.array(*parts).alias("g")).select(F.inline("g"))
    rate = F.col("numerator") / F.nullif(F.col("denominator"), F.lit(0))
    return out.withColumn("status", F.when(rate.isNull(), "insufficient").when(rate >= F.col("threshold"), "pass").otherwise("fail"))


def reconstruct(rows: DataFrame, keys: Sequence[str], result: str, clock: str, cutoff: Column) -> DataFrame:
    """Wins, losses, draws before the cutoff; a single unknown clock makes them all null."""
    known = F.count_if(F.col(clock).isNull()) == 0
    before = F.col(clock) <= cutoff
    tell = lambda v: F.when(known, F.count_if(before & (F.col(result) == v)))
    return rows.groupBy(*keys).agg(F.when(known, "complete").otherwise("unknown").alias("completeness"), tell("win").alias("wins"), tell("loss").alias("losses"), tell("draw").alias("draws"), F.count_if(F.col(clock).isNull()).alias("unknown_clocks"))


def coverage(skeleton: DataFrame, facts: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Found and missing against a fixed skeleton, so that the denominator doesn't depend on what was found."""
    there = facts.select(*keys).distinct().withColumn("__there", F.lit(True))
    out = skeleton.join(there, list(keys), "left")
    return out.groupBy(*by).agg(F.count("*").alias("expected"), F.count_if(F.col("__there").isNotNull()).alias("found"), F.count_if(F.col("__there").isNull()).alias("missing"))


def health(components: DataFrame, status: str = "status", required: str = "required") -> DataFrame:
    """The worst colour of all components, and the red ones' number."""
    rank = F.when(F.col(status) == "healthy", 0).when(F.col(status) == "stale", 1).when((F.col(status) == "missing") & ~F.col(required), 1).otherwise(2)
    worst = components.agg(F.max(rank).alias("__w"), F.count_if(rank == 2).alias("blockers"), F.count("*").alias("components"))
    return worst.select(F.get(F.array(F.lit("green"), F.lit("yellow"), F.lit("red")), F.col("__w")).alias("colour"), "blockers", "components")


def dedupe_by_precedence(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
