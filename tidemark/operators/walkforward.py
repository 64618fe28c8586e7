"""Walk-forward backtests by prefix sums: every card is predicted from what was known at its cutoff, at a cost linear in cards.

What a result adds to a fit is a signed row at the time when it became known: its moments, and under its raw probability
a count of the calibrator's bin. A correction takes the earlier label out and brings the new one in. A card's fit is the
sum of all rows up to its cutoff, so no fold is made and no loop goes over cards: two passes of running sums, one for the
weights, one for the calibrator, whose bins need the first. Features are whole numbers of 1 / scale and sums are
decimals, so a sum doesn't depend on partitions, and cards that come later change no bit of an earlier prediction.

A walk may end at any time and go on from there: rows up to that time are summed to one (`compact`), which is its state.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ledger import stored

#: Order at one time: results that become known, cards that ask, results known too early, which count after their card.
KNOWN, ASKS, EARLY = 0, 1, 2
WHOLE = "decimal(20,0)"


@dataclass(frozen=True)
class Model:
    """Ridge on differences between corners, without an intercept, so that swapped corners give 1 - p; then shrunk counts by bin.

    `ridge` is in units of a feature's mean square. `prior` is the weight of the raw probability against a bin's counts.
    """

    features: tuple[str, ...]
    scale: int = 100
    ridge: float = 1.0
    bins: int = 20
    prior: float = 25.0
    edge: float = 0.01

    @property
    def sums(self) -> tuple[str, ...]:
        d = range(len(self.features))
        return ("n", *(f"b{i}" for i in d), *(f"s{i}_{j}" for i in d for j in d if j >= i))


@dataclass(frozen=True)
class Walk:
    """predictions: contest, card, cutoff, holdout, status, n_train, weights, bin, raw, p. moments and hits: the signed rows, by at and kind. fits: at, n_train, weights (of whole numbers)."""

    predictions: DataFrame
    moments: DataFrame
    hits: DataFrame
    fits: DataFrame


def label_changes(versions: DataFrame) -> DataFrame:
    """contest, seen, sign, y: how the label that holds changes as versions (contest, rank, seen, y) become known.

    The version of the highest rank holds, of one rank the one seen last; a null y (a draw) labels nothing. Versions
    without a contest or a time are never known. A repeated version changes nothing.
    """
    order = ["seen", "rank", "y"]
    w = Window.partitionBy("contest").orderBy(*order)
    known = versions.where("contest IS NOT NULL AND seen IS NOT NULL").withColumn("now", F.max(F.struct("rank", "seen", "y")).over(w.rowsBetween(Window.unboundedPreceding, 0))["y"])
    steps = known.withColumn("was", F.lag("now").over(w)).where(~F.col("was").eqNullSafe(F.col("now")))
    signed = F.array(F.struct(F.lit(-1).alias("sign"), F.col("was").alias("y")), F.struct(F.lit(1).alias("sign"), F.col("now").alias("y")))
    return steps.select("contest", "seen", F.inline(signed)).where("y IS NOT NULL")


def totals_at(changes: DataFrame, asks: DataFrame, sums: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """asks (keys, at) with the sums of all changes (keys, at, kind, sums) of their keys that come before them.

    Keys and times are one line, dealt by ranges; each task walks its range, and what the ranges before hold is a row
    for each range and key that occurs in it.
    """
    zero = [F.lit(0).cast(changes.schema[s].dataType).alias(s) for s in sums]
    line = changes.select(*keys, "at", "kind", *sums).unionByName(asks.select(*keys, "at").distinct().select(*keys, "at", F.lit(ASKS).alias("kind"), *zero))
    line = stored(line, "walk-line")  # dealing by ranges reads its input twice
    spread = stored(line.repartitionByRange(*keys, "at", "kind").withColumn("part", F.spark_partition_id()), "walk-line")
    here = Window.partitionBy("part", *keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = spread.groupBy("part", *keys).agg(*[F.sum(s).alias(s) for s in sums])
    before = ranges.select("part", *keys, *[F.sum(s).over(earlier).alias(f"{s}__before") for s in sums])
    walked = spread.select("part", *keys, "at", "kind", *[F.sum(s).over(here).alias(s) for s in sums]).where(F.col("kind") == ASKS)
    return walked.join(before, ["part", *keys]).select(*keys, "at", *[(F.col(s) + F.coalesce(F.col(f"{s}__before"), F.lit(0))).alias(s) for s in sums])


def compact(changes: DataFrame, sums: Sequence[str], until: datetime, keys: Sequence[str] = ()) -> DataFrame:
    """What all changes up to a time come to, as changes at that time: one row for each key."""
    now = F.lit(until).cast("timestamp_ntz")
    return changes.where(F.col("at") <= now).groupBy(*keys).agg(*[F.sum(s).cast(changes.schema[s].dataType).alias(s) for s in sums]).where(F.col(sums[0]).isNotNull()).select(*keys, now.alias("at"), F.lit(KNOWN).alias("kind"), *sums)


def weights_of(model: Model) -> Column:
    """The ridge weights of a row of sums, for features as whole numbers; a feature that was 0 throughout gets 0."""
    d = len(model.features)
    upper = np.triu_indices(d)

    @F.pandas_udf("array<double>")
    def solve(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        m = np.stack([np.asarray(r, float) for r in rows])
        s = np.zeros((len(m), d, d))
        s[:, upper[0], upper[1]] = m[:, 1 + d :]
        s[:, upper[1], upper[0]] = m[:, 1 + d :]
        at = np.arange(d)
        own = s[:, at, at]
        s[:, at, at] = np.where(own > 0, own * (1 + model.ridge / np.maximum(m[:, :1], 1)), 1)
        return pd.Series(list(np.linalg.solve(s, m[:, 1 : 1 + d, None])[:, :, 0]))

    return solve(F.array(*[F.col(c).cast("double") for c in model.sums]))


def fits_at(moments: DataFrame, asks: DataFrame, model: Model) -> DataFrame:
    """at, n_train, weights for each time that is asked for."""
    t = totals_at(moments, asks, model.sums)
    return t.select("at", F.col("n").cast("long").alias("n_train"), weights_of(model).alias("weights"))


def _start(changes: DataFrame | None, rows: DataFrame) -> DataFrame:
    return rows if changes is None else rows.unionByName(changes.select(*rows.columns))


def walk(contests: DataFrame, cards: DataFrame, versions: DataFrame, model: Model, after: datetime | None = None, state: Walk | None = None) -> Walk:
    """Predictions of all contests (contest, card, holdout, features) whose card (card, cutoff) comes after a time.

    A result counts for a card if it was seen at its cutoff or before; one that was seen before its own card's cutoff
    counts after that cutoff only, so no card trains on itself. Contests that are held out are predicted and never
    trained on, neither for weights nor for the calibrator. A contest without features, or whose card has no cutoff, has
    no prediction and a status that says so; it trains nothing. Before any result p is 0.5. A card named twice has its
    earliest cutoff; a contest named twice counts twice. Empty tables give no rows.

    To go on after a time: its `state` of compact rows and of the fits of earlier cards; contests and versions then need
    to hold new cards and contests with new versions only.
    """
    cuts = cards.groupBy("card").agg(F.min("cutoff").alias("cutoff"))
    whole = [F.round(F.col(c).cast("double") * model.scale) for c in model.features]
    # NaN is a missing value too
    x = F.when(sum((F.coalesce(F.isnan(c) | c.isNull(), F.lit(True)).cast("int") for c in whole), F.lit(0)) == 0, F.array(*[c.cast("long") for c in whole]))
    base = contests.join(cuts, "card", "left").select("contest", "card", "cutoff", F.coalesce("holdout", F.lit(False)).alias("holdout"), x.alias("x"))
    usable = base.where("cutoff IS NOT NULL AND x IS NOT NULL")
    early = F.col("seen") <= F.col("cutoff")
    changes = label_changes(versions).join(usable.where("NOT holdout"), "contest")
    changes = changes.select("sign", "y", "x", "cutoff", F.greatest("seen", "cutoff").alias("at"), F.when(early, EARLY).otherwise(KNOWN).alias("kind"))
    new = F.lit(True) if after is None else F.col("cutoff") > F.lit(after).cast("timestamp_ntz")
    if after is not None:
        changes = changes.where(F.col("at") > F.lit(after).cast("timestamp_ntz"))
    changes = stored(changes, "walk-changes")

    d, v = len(model.features), lambda i: F.col("x")[i].cast(WHOLE)
    side = F.col("sign") * (2 * F.col("y") - 1)
    terms = [F.col("sign").cast(WHOLE), *[(side * F.col("x")[i]).cast(WHOLE) for i in range(d)], *[F.col("sign").cast(WHOLE) * (v(i) * v(j)).cast(WHOLE) for i in range(d) for j in range(i, d)]]
    moments = changes.groupBy("at", "kind").agg(*[F.sum(t).cast("decimal(38,0)").alias(s) for s, t in zip(model.sums, terms, strict=True)])
    moments = stored(_start(state and state.moments, moments), "walk-moments")

    asks = usable.where(new).select(F.col("cutoff").alias("at"))
    fresh = stored(fits_at(moments, asks, model), "walk-fits")
    known = _start(state and state.fits, fresh).withColumnRenamed("at", "cutoff")
    line = F.aggregate(F.zip_with("weights", "x", lambda w, a: w * a), F.lit(0.0), lambda s, t: s + t)
    raw = F.when(line.isNotNull(), F.least(F.greatest(0.5 + line / 2, F.lit(model.edge)), F.lit(1 - model.edge)))  # least and greatest pass over nulls
    into = F.least(F.floor(raw * model.bins), F.lit(model.bins - 1)).cast("int")
    told = changes.join(known, "cutoff").select("sign", "y", "at", "kind", into.alias("bin"))
    hits = told.groupBy("bin", "at", "kind").agg(F.sum("sign").cast("decimal(38,0)").alias("n"), F.sum(F.col("sign") * F.col("y")).cast("decimal(38,0)").alias("won"))
    hits = stored(_start(state and state.hits, hits), "walk-hits")

    mine = base.where(new | F.col("cutoff").isNull()) if after is not None else base
    scored = mine.join(known, "cutoff", "left").withColumn("raw", raw).withColumn("bin", F.when(F.col("raw").isNotNull(), into))
    # every bin of the cards is asked for, which needs no pass over the contests
    asked = fresh.select("at", F.explode(F.sequence(F.lit(0), F.lit(model.bins - 1))).alias("bin"))
    seen = totals_at(hits, asked, ("n", "won"), ("bin",)).withColumnRenamed("at", "cutoff")
    n, won = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("n", "won"))
    p = (won + model.prior * F.col("raw")) / (n + model.prior)
    status = F.when(F.col("cutoff").isNull(), "no_cutoff").when(F.col("x").isNull(), "no_features").otherwise("scored")
    out = scored.join(seen, ["bin", "cutoff"], "left").select("contest", "card", "cutoff", "holdout", status.alias("status"), "n_train", F.transform("weights", lambda w: w * model.scale).alias("weights"), "bin", "raw", F.when(F.col("raw").isNotNull(), p).alias("p"))
    return Walk(out, moments, hits, fresh)


def digests(predictions: DataFrame) -> DataFrame:
    """card, n, digest: of each card's predictions, equal whatever their order; combined before the shuffle."""
    h = F.conv(F.substring(F.md5(F.to_json(F.struct("contest", "status", "n_train", "weights", "raw", "p"))), 1, 15), 16, 10).cast("long")
    return predictions.groupBy("card").agg(F.count("*").alias("n"), F.bit_xor(h).alias("digest"))
