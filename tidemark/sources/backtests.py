"""A walk-forward backtest that is kept up: each advance predicts the cards up to a time and leaves the state to go on from.

State, fits and predictions of an advance become visible with one manifest, as in `ingest`; one that stops before leaves
nothing, and is done again from the state before. Earlier cards are neither read nor predicted again: an advance takes
the contests of new cards, and those with versions seen since.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import walkforward
from tidemark.operators.ledger import PACKED, stored, sweeping
from tidemark.operators.walkforward import Model, Walk
from tidemark.sources.ingest import Store, bucket_of

PREDICTION = "contest string, card string, cutoff timestamp_ntz, holdout boolean, status string, n_train long, weights array<double>, bin int, raw double, p double"
FIT = "at timestamp_ntz, n_train long, weights array<double>"


class Backward(ValueError):
    """An advance to a time that isn't after the last one's."""


class Backtest(Store):
    """Contests, cards and versions are given whole; what is behind the last advance is filtered at the scan. Versions are seen in order: one that is given later with an earlier time isn't picked up."""

    tables = ("predictions", "fits", "moments", "hits")

    def __init__(self, spark: SparkSession, root: str, model: Model, buckets: int = 64):
        super().__init__(spark, root, buckets)
        self.model = model
        sums = ", ".join(f"{s} decimal(38,0)" for s in model.sums)
        self._schemas = {"predictions": PREDICTION, "fits": FIT, "moments": f"at timestamp_ntz, kind int, {sums}", "hits": "bin int, at timestamp_ntz, kind int, n decimal(38,0), won decimal(38,0)"}

    def predictions(self) -> DataFrame:
        return self._table("predictions", PREDICTION).drop("batch", "bucket")

    def reached(self) -> datetime | None:
        last = self.manifests().agg(F.max_by("token", "number")).first()[0]
        return datetime.fromisoformat(last) if last else None

    def _state(self) -> Walk:
        """Of the last advance one row of moments and one for each bin; of all the fits of their cards."""
        last = self.manifests().agg(F.max_by("batch", "number")).first()[0]
        moments, hits = (self._table(n, self._schemas[n]).where(F.col("batch") == last).drop("batch", "bucket") for n in ("moments", "hits"))
        return Walk(self.predictions(), moments, hits, self._table("fits", FIT))

    @sweeping
    def advance(self, contests: DataFrame, cards: DataFrame, versions: DataFrame, until: datetime, between: Callable[[str], None] = lambda step: None) -> None:
        """Predicts the cards after the last advance and up to a time, from results seen until then. A contest whose card has no cutoff is never reached."""
        after, numbers = self.reached(), self._numbers()
        if after is not None and until <= after:
            raise Backward(f"{until} isn't after {after}")
        now = F.lit(until).cast("timestamp_ntz")
        seen, due = versions.where(F.col("seen") <= now), stored(cards.groupBy("card").agg(F.min("cutoff").alias("cutoff")), "walk-cards").where(F.col("cutoff") <= now)
        mine, state = contests.join(due, "card", "left_semi"), None
        if after is not None:
            then = F.lit(after).cast("timestamp_ntz")
            fresh = mine.join(due.where(F.col("cutoff") > then), "card", "left_semi").select("contest")
            touched = stored(fresh.unionByName(seen.where(F.col("seen") > then).select("contest")).distinct(), "walk-touched")
            mine, seen = (df.join(touched, "contest", "left_semi") for df in (mine, seen))
            state = self._state()
        walked = walkforward.walk(mine, due, seen, self.model, after, state)
        batch = uuid.uuid4().hex
        parts = {
            "predictions": walked.predictions.withColumn("bucket", bucket_of(self.buckets, "contest")), "fits": walked.fits.withColumn("bucket", bucket_of(self.buckets, "at")),
            "moments": walkforward.compact(walked.moments, self.model.sums, until).withColumn("bucket", F.lit(0)), "hits": walkforward.compact(walked.hits, ("n", "won"), until, ("bin",)).withColumn("bucket", F.lit(0)),
        }
        for name, rows in parts.items():
            rows.repartition("bucket").write.options(**PACKED).partitionBy("bucket").parquet(f"{self.root}/{name}/batch={batch}")
            between(name)
        self._publish((numbers[-1] if numbers else 0) + 1, {"number": (numbers[-1] if numbers else 0) + 1, "batch": batch, "run": batch, "source": "walk", "stream": "walk", "scope": "all", "version": "v1", "token": until.isoformat(timespec="microseconds")})
