"""Ticks: cadence windows before an event, slots anchored in them, due work, quotas, lifecycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name, seconds before the start where it opens and closes (closed, open), and its interval (fixed values).
CADENCE = (("far", 259200, 86400, 1800), ("mid", 86400, 21600, 600), ("near", 21600, 3600, 300), ("final", 3600, 0, 120))
#: Allowed moves of a selection's life.
MOVES = {"active": ("suspended", "replaced", "cancelled", "closed"), "suspended": ("active", "cancelled", "closed"), "replaced": ("active",), "cancelled": (), "closed": ()}


def cadence(seconds_before: Column) -> Column:
    """A struct of window, opens (seconds before the start) and interval; null outside all."""
    out = None
    for name, opens, closes, interval in CADENCE:
        hit = (seconds_before <= opens) & (seconds_before > closes)
        value = F.struct(F.lit(name).alias("window"), F.lit(opens).alias("opens"), F.lit(interval).alias("interval"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def slot(elapsed: Column, interval: Column) -> Column:
    """Seconds since the anchor, floored to the interval."""
    return elapsed - elapsed % interval


def due_work(events: DataFrame, done: DataFrame, keys: Sequence[str], within: Column) -> DataFrame:
    """Each event's slot: no_op outside the windows, done if its key succeeded before, else due."""
    d = done.select(*keys).distinct().withColumn("__done", F.lit(True))
    return events.join(d, list(keys), "left").withColumn("work", F.when(~within, "no_op").when(F.col("__done"), "done").otherwise("due")).drop("__done")


def quota(requests: DataFrame, group: Sequence[str], order: Sequence[str], cost: str, remaining: int, reserve: int) -> DataFrame:
    """Allowed while the running cost leaves the reserve, deferred while it leaves something, else exhausted."""
    spent = F.sum(cost).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    left = remaining - spent
    return requests.withColumns({"left": left, "decision": F.when(left >= reserve, "allowed").when(left >= 0, "deferred").otherwise("exhausted")})


def moves(states: DataFrame, keys: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """Adds the state before and whether the move is allowed; the first state is."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(*order))
    table = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    ok = F.coalesce(before.isNull() | (before == F.col(state)) | F.array_contains(F.try_element_at(table, before), F.col(state)), F.lit(False))
    return states.withColumns({"before": before, "allowed": ok})
