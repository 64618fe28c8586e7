"""Odds, value and staking as column expressions. Inputs out of their domain give null, never a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIONABLE_EV, STRONG_EV, EXACT_ROUND_EV = 0.05, 0.10, 0.10
CONFIRMED_SURE, EXACT_ROUND_SURE = 0.70, 0.75


def valid_probability(p: Column) -> Column:
    return F.coalesce(~F.isnan(p) & (p > 0) & (p < 1), F.lit(False))


def valid_decimal(d: Column) -> Column:
    return F.coalesce(~F.isnan(d) & (d > 1) & (d < float("inf")), F.lit(False))


def valid_american(a: Column) -> Column:
    return F.coalesce(~F.isnan(a) & ((a <= -100) | (a >= 100)), F.lit(False))


def american_to_decimal(a: Column) -> Column:
    return F.when(valid_american(a), F.when(a > 0, 1 + a / 100).otherwise(1 + 100 / F.abs(a)))


def decimal_to_american(d: Column) -> Column:
    return F.when(valid_decimal(d), F.when(d >= 2, (d - 1) * 100).otherwise(-100 / (d - 1)))


def implied_probability(d: Column) -> Column:
    return F.when(valid_decimal(d), 1 / d)


def probability_to_decimal(p: Column) -> Column:
    return F.when(valid_probability(p), 1 / p)


def expected_value(p: Column, d: Column, void: Column | None = None) -> Column:
    """Of a unit stake; with a void share the loss share is what is left."""
    return p * d - 1 if void is None else p * (d - 1) - (1 - p - void)


def conditional_win(p: Column, void: Column) -> Column:
    return F.when(void < 1, p / (1 - void))


def line_value(opening: Column, closing: Column) -> Column:
    """Closing line value in probability points."""
    return 1 / closing - 1 / opening


def unit_profit(settlement: Column, d: Column) -> Column:
    return F.when(settlement == "WIN", d - 1).when(settlement == "LOSS", -1.0).when(settlement.isin("PUSH", "VOID"), 0.0)


def kelly(p: Column, d: Column, void: Column | None = None) -> Column:
    """Full Kelly share, negative where there is no edge; a void share conditions the probability."""
    win = p if void is None else conditional_win(p, void)
    return (win * (d - 1) - (1 - win)) / (d - 1)


def capped_kelly(p: Column, d: Column, void: Column | None = None, part: float = 0.25, cap: float = 0.01) -> Column:
    return F.least(F.greatest(kelly(p, d, void) * part, F.lit(0.0)), F.lit(cap))


def price_targets(p50: Column, p25: Column, family: Column) -> Column:
    """A struct: fair, break-even, actionable and strong prices; null unless 0 < p25 <= p50 < 1."""
    target = F.when(family == "exact_round", EXACT_ROUND_EV).otherwise(ACTIONABLE_EV)
    strong = F.greatest(F.lit(STRONG_EV), target)
    out = F.struct((1 / p50).alias("fair"), (1 / p25).alias("break_even"), F.greatest(1 / p25, (1 + target) / p50).alias("actionable"), F.greatest(1 / p25, (1 + strong) / p50).alias("strong"))
    return F.when(valid_probability(p50) & valid_probability(p25) & (p25 <= p50), out)


def price_class(p50: Column, p25: Column, family: Column, gates: Column, qualified: Column, offered: Column, sure: Column) -> Column:
    """confirmed_value, price_target or no_bet: the last if a gate fails, or an offer is below the actionable price or too unsure (P(EV > 0))."""
    fair = gates & qualified
    least = F.when(family == "exact_round", EXACT_ROUND_SURE).otherwise(CONFIRMED_SURE)
    met = (offered >= price_targets(p50, p25, family)["actionable"]) & (sure >= least)
    return F.when(~F.coalesce(fair, F.lit(False)), "no_bet").when(offered.isNull(), "price_target").when(F.coalesce(met, F.lit(False)), "confirmed_value").otherwise("no_bet")


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def smoothed_rate(k: Column, n: Column) -> Column:
    """Laplace: (k + 1) / (n + 2)."""
    return (k + 1) / (n + 2)


def safe_difference(left: Column, right: Column, left_missing: Column, right_missing: Column) -> Column:
    """Zero if either side is missing."""
    return F.when(left_missing | right_missing, 0.0).otherwise(left - right)


def quality_flag(completeness: Column) -> Column:
    return F.when(completeness >= 0.75, "healthy").when(completeness >= 0.40, "partial").otherwise("sparse")


def canonical_float(x: Column) -> Column:
    """Ten places, halves to even, and no negative zero."""
    return F.bround(x, 10) + F.lit(0.0)


def softmax(logits: Column) -> Column:
    """Of an array; shifted by its largest value."""
    most = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - most))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))
