"""Prices as of a cutoff: the exclusion ladder, complete-set probabilities, closing prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKING = ("suspended", "removed", "cancelled")


def join_quotes(wanted: DataFrame, quotes: DataFrame, keys: Sequence[str], cutoff: Column) -> DataFrame:
    """To each wanted selection its newest price at the cutoff, or the first reason against one.

    Keys compare null-safe. One aggregation of the quotes per selection, then the ladder: threshold_only (no quote),
    post_cutoff, ambiguous (any flagged, or several prices at the newest time), replaced, stale, suspended, ineligible.
    quotes: keys, quote_id, observed_at, price, availability, lifecycle, eligible, replacement, ambiguous.
    """
    seen = F.col("observed_at") <= cutoff
    at_newest = lambda price: F.max(F.when(seen & F.col("price").isNotNull(), F.struct("observed_at", price.alias("p"))))
    agg = quotes.groupBy(*keys).agg(
        F.count("*").alias("__n"),
        F.count_if(~seen).alias("later_ignored"),
        F.max(F.when(seen, F.struct("observed_at", "quote_id", "price", "availability", "lifecycle", "eligible", "replacement"))).alias("q"),
        F.coalesce(F.bool_or(F.when(seen, F.col("ambiguous"))), F.lit(False)).alias("__ambiguous"),
        at_newest(F.col("price")).alias("__high"),
        at_newest(-F.col("price")).alias("__low"),
    )
    side = agg.select(*[F.col(k).alias(f"__{k}") for k in keys], "__n", "later_ignored", "q", "__ambiguous", F.coalesce((F.col("__high.observed_at") == F.col("q.observed_at")) & (F.col("__high.p") != -F.col("__low.p")), F.lit(False)).alias("__prices"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    q = F.col("q")
    reason = (
        F.when(F.col("__n").isNull(), "threshold_only")
        .when(q.isNull(), "post_cutoff_odds")
        .when(F.col("__ambiguous") | F.col("__prices"), "ambiguous_odds")
        .when(q["replacement"] | (q["lifecycle"] == "replaced"), "replaced_odds")
        .when(q["lifecycle"] == "stale", "stale_odds")
        .when((q["availability"] != "available") | q["lifecycle"].isin(*BLOCKING), "suspended_odds")
        .when(~q["eligible"], "ineligible_quote")
    )
    out = wanted.join(side, on, "left").withColumn("reason", reason)
    price = F.when(F.col("reason").isNull(), q["price"])
    return out.select(*wanted.columns, "reason", price.alias("price"), F.when(F.col("reason").isNull(), q["quote_id"]).alias("quote_id"), F.coalesce("later_ignored", F.lit(0)).cast("long").alias("later_ignored"))


def shares(prices: DataFrame, market: Sequence[str], price: str) -> DataFrame:
    """Adds no_vig (share of 1/price in its market) and overround of all prices as they stand, whatever their domain; a null price has no share, and 0 is divided by as in floating point."""
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.when(b == 0, a * float("inf")))
    out = prices.withColumn("__one", over(F.lit(1.0), F.col(price))).withColumn("__sum", F.sum("__one").over(Window.partitionBy(*market)))
    return out.withColumns({"no_vig": over(F.col("__one"), F.col("__sum")), "overround": F.col("__sum") - 1}).drop("__one", "__sum")


def devig(prices: DataFrame, market: Sequence[str], outcome: str, price: str, expected: int | None = None) -> DataFrame:
    """Adds no_vig (share of 1/price in its market), overround and complete.

    A market isn't complete, and has no probabilities, if a price is out of its domain, an outcome comes twice, or not
    `expected` outcomes came.
    """
    w = Window.partitionBy(*market)
    bad = F.col(price).isNull() | (F.col(price) <= 1)
    out = prices.withColumns({"__sum": F.sum(1 / F.col(price)).over(w), "__n": F.count("*").over(w), "__bad": F.max(bad.cast("int")).over(w), "__d": F.size(F.collect_set(outcome).over(w)) if expected else F.lit(0)})
    ok = F.col("__bad") == 0
    if expected:
        ok &= (F.col("__n") == expected) & (F.col("__d") == expected)
    out = out.withColumn("complete", ok)
    return out.withColumns({"no_vig": F.when(ok, 1 / F.col(price) / F.col("__sum")), "overround": F.when(ok, F.col("__sum") - 1)}).drop("__sum", "__n", "__bad", "__d")


def freshness(updated: Column, observed: Column, as_of: Column) -> Column:
    """The source's clock, else the observation's; null if the one that counts lies ahead."""
    clock = F.coalesce(updated, observed)
    return F.when((clock <= as_of) & (observed <= as_of), clock)


def is_stale(fresh: Column, as_of: Column, minutes: int = 360) -> Column:
    """Strictly older than the limit; unknown is stale."""
    return fresh.isNull() | (as_of - F.expr(f"INTERVAL {minutes} MINUTES") > fresh)


def unknown_blocks(unknown_at: Column, quote_at: Column) -> Column:
    """An UNKNOWN observation blocks until a strictly newer quote."""
    return unknown_at.isNotNull() & F.coalesce(quote_at <= unknown_at, F.lit(True))
