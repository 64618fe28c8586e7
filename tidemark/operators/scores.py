"""Scores of probabilities: losses, calibration, skill, breakdowns over overlapping universes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges of ten equal bins as binary fractions give them; the last bin is closed.
BIN_EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def brier(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def bin_of(p: Column) -> Column:
    """How many inner edges p has reached."""
    return sum(((p >= e).cast("int") for e in BIN_EDGES[1:-1]), F.lit(0))


def reliability(rows: DataFrame, y: str, p: str, least: int = 20) -> DataFrame:
    """Per bin: count, mean prediction, observed share (hidden where the bin is weak) and gap. Empty bins are left out."""
    out = rows.groupBy(bin_of(F.col(p)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("__o"))
    weak = F.col("n") < least
    return out.select("bin", "n", "predicted", F.when(~weak, F.col("__o")).alias("observed"), weak.alias("weak"), F.abs(F.col("__o") - F.col("predicted")).alias("gap"))


def calibration_error(rows: DataFrame, y: str, p: str) -> DataFrame:
    bins = reliability(rows, y, p, 0)
    return bins.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"), F.count("*").alias("bins"))


def skill(rows: DataFrame, y: str, p: str, baselines: Mapping[str, Column]) -> DataFrame:
    """Against each baseline the loss difference over rows where it is known, and how many miss it: one pass over the rows."""
    named = F.array(*[F.struct(F.lit(k).alias("baseline"), v.cast("double").alias("b")) for k, v in baselines.items()])
    long = rows.select(F.col(y).alias("y"), F.col(p).alias("p"), F.inline(named))
    there = F.col("b").isNotNull()
    gain = F.avg(F.when(there, log_loss(F.col("y"), F.col("b")))) - F.avg(F.when(there, log_loss(F.col("y"), F.col("p"))))
    return long.groupBy("baseline").agg(gain.alias("skill"), F.count_if(there).alias("n"), F.count_if(~there).alias("n_missing"))


def breakdowns(rows: DataFrame, dimensions: Mapping[str, Column], aggregates: Mapping[str, Column]) -> DataFrame:
    """The same aggregates by every dimension; a dimension gives an array, as a row may lie in several of its universes."""
    cells = F.flatten(F.array(*[F.transform(v, _pair(k)) for k, v in dimensions.items()]))
    long = rows.withColumn("__cells", cells).select("*", F.inline("__cells")).drop("__cells")
    return long.groupBy("dimension", "universe").agg(*[v.alias(k) for k, v in aggregates.items()])


def _pair(dimension: str):
    return lambda x: F.struct(F.lit(dimension).alias("dimension"), x.cast("string").alias("universe"))


def multiclass(rows: DataFrame, group: list[str], probability: str, won: str, eps: float = 1e-15) -> DataFrame:
    """Per group of outcomes: log loss of the winner after normalising and the multiclass Brier score; groups with several winners are flagged."""
    total = F.sum(probability)
    g = rows.groupBy(*group).agg(total.alias("__t"), F.sum(F.col(won).cast("int")).alias("winners"), F.sum(F.when(F.col(won), F.col(probability))).alias("__w"), F.sum(F.col(probability) * F.col(probability)).alias("__pp"))
    share = F.col("__w") / F.col("__t")
    ok = (F.col("winners") == 1) & (F.col("__t") > 0)
    return g.select(*group, "winners", F.when(ok, -F.ln(F.greatest(share, F.lit(eps)))).alias("log_loss"), F.when(ok, F.col("__pp") / (F.col("__t") * F.col("__t")) - 2 * share + 1).alias("brier"))


def reconciliation(rows: DataFrame, dimensions: Mapping[str, Column], measures: Mapping[str, Column]) -> DataFrame:
    """dimension, measure, total, slices, ok: whether each dimension's universes add up to the whole, in one aggregation.

    A dimension gives an array as in `breakdowns`; a row in no universe, or in two, makes it not add up. A null array is
    no universe, a null measure is 0; measures are whole numbers.
    """
    m = {k: F.coalesce(v.cast("long"), F.lit(0)) for k, v in measures.items()}
    size = {d: F.coalesce(F.size(v), F.lit(0)) for d, v in dimensions.items()}
    sums = [F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("measure"), F.coalesce(F.sum(v), F.lit(0)).alias("total"), F.coalesce(F.sum(v * s), F.lit(0)).alias("slices")) for d, s in size.items() for k, v in m.items()]
    return rows.agg(F.array(*sums).alias("a")).select(F.inline("a")).withColumn("ok", F.col("total") == F.col("slices"))


def terminal_log_loss(rows: DataFrame, chances: str, observed: str, tolerance: float = 1e-10, eps: float = 1e-15) -> DataFrame:
    """One row: n, n_mass (chances that don't add up to 1), n_missing (what happened isn't among them), n_impossible (it had no chance), and nll, the mean loss of what happened.

    chances: a map of names to chances. Without rows, or with a row at fault, there is no nll. A null or NaN chance spoils
    its row's mass; a null map counts as mass and as missing.
    """
    # aggregate over the values, as a null among them must show
    mass = F.aggregate(F.map_values(chances), F.lit(0.0), lambda s, x: s + x)
    off = F.coalesce(F.isnan(mass) | (F.abs(mass - 1) > tolerance), F.lit(True))
    missing = ~F.coalesce(F.map_contains_key(chances, F.col(observed)), F.lit(False))
    p = F.try_element_at(chances, F.col(observed))
    impossible = ~missing & F.coalesce(F.isnan(p) | (p <= 0), F.lit(True))
    found = rows.select(off.alias("off"), missing.alias("missing"), impossible.alias("impossible"), (-F.ln(F.greatest(p, F.lit(eps)))).alias("loss"))
    counts = found.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{a}") for c, a in (("off", "mass"), ("missing", "missing"), ("impossible", "impossible"))], F.avg("loss").alias("mean"))
    return counts.select("n", "n_mass", "n_missing", "n_impossible", F.when(F.col("n_mass") + F.col("n_missing") + F.col("n_impossible") == 0, F.col("mean")).alias("nll"))
