"""Joins and filters in time. A fact is visible at a cutoff if it took effect before it and was observed by it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(effective: Column, observed: Column, cutoff: Column, strict_effective: bool = True) -> Column:
    """effective < cutoff (or <=) and observed <= cutoff; a null clock is never visible."""
    before = effective < cutoff if strict_effective else effective <= cutoff
    return F.coalesce(before & (observed <= cutoff), F.lit(False))


def admitted(effective: Column, observed: Column, cutoff: Column, group: Column, own_group: Column) -> Column:
    """visible, and not of the group that is asked about; a null group passes."""
    return visible(effective, observed, cutoff) & F.coalesce(group != own_group, F.lit(True))


def cutoff_of(start: Column, day: Column, allow_proxy: bool = False, minutes: int = 60) -> Column:
    """A struct of cutoff and kind: an hour before the start, or if allowed midnight of the day, which nothing is taken from."""
    scheduled = start - F.expr(f"INTERVAL {minutes} MINUTES")
    proxy = F.when(F.lit(allow_proxy), day.cast("timestamp_ntz"))
    kind = F.when(start.isNotNull(), "scheduled").when(proxy.isNotNull(), "proxy").otherwise("missing")
    return F.struct(F.coalesce(scheduled, proxy).alias("cutoff"), kind.alias("kind"))


def visibility_clock(quality: Column, published: Column, updated: Column, adjudicated: Column, effective: Column, proxy: Column, observed: Column) -> Column:
    """Direct and revision times say when a fact was published; proxies have their own clock; others go by observation."""
    return F.when(quality.isin("direct", "revision"), F.coalesce(published, updated, adjudicated, effective)).when(quality == "publication_proxy", proxy).otherwise(observed)


def latest_as_of(facts: DataFrame, keys: Sequence[str], order: Sequence[str], cutoff: Column, effective: str = "effective_at", observed: str = "observed_at") -> DataFrame:
    """Per key the visible fact that is last by `order`, which must end in a unique column. One aggregation, no sort."""
    rest = [c for c in facts.columns if c not in keys]
    seen = facts.where(visible(F.col(effective), F.col(observed), cutoff))
    return seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__v")).select(*keys, "__v.*")


def first_as_of(facts: DataFrame, keys: Sequence[str], order: Sequence[str], cutoff: Column, effective: str = "effective_at", observed: str = "observed_at") -> DataFrame:
    """latest_as_of from the other end."""
    rest = [c for c in facts.columns if c not in keys]
    seen = facts.where(visible(F.col(effective), F.col(observed), cutoff))
    return seen.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__v")).select(*keys, "__v.*")


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], tie: str, strict: bool = False) -> DataFrame:
    """To each left row the values of the last right row of its key at or before (strict: before) its time.

    Both sides are one stream, sorted once in each key's partition, and the last right row is carried forward: the cost
    is that of a sort, whatever the number of right rows before a left row. Left rows without one keep nulls.
    """
    l = left.select(*left.columns, F.col(left_time).alias("__t"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("__v"), F.lit(0 if strict else 2).alias("__side"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"))
    blank = [F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns]
    r = right.select(*blank, F.col(right_time).alias("__t"), F.struct(*values).alias("__v"), F.lit(1).alias("__side"), F.col(tie).alias("__tie"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side", F.col("__tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side <> 1")
    return both.select(*left.columns, *[F.col("__last")[v].alias(v) for v in values])


def closing_forward(opens: DataFrame, keys: Sequence[str], time: str, tie: str, values: Sequence[str], horizon_seconds: int) -> DataFrame:
    """To each row the last row of its key that is later than it, by seconds, and within the horizon: a range frame, no join."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).cast("timestamp").cast("long")).rangeBetween(1, horizon_seconds)
    last = F.max(F.struct(F.col(time).alias("__t"), F.col(tie).alias("__i"), *values)).over(w)
    return opens.withColumn("__c", last).select(*opens.columns, *[F.col("__c")[v].alias(f"closing_{v}") for v in values], F.col("__c")["__i"].alias(f"closing_{tie}"))


def versions(changes: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """Adds version (1, 2, ...) and superseded_at, the time of the next change of the key; null for the last."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    return changes.withColumns({"version": F.row_number().over(w).cast("long"), "superseded_at": F.lead(time).over(w)})


def last_n_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, sums: dict[str, Column]) -> DataFrame:
    """Sums over the last n rows of the key before each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
    return rows.withColumns({k: v.over(w) for k, v in sums.items()})


def layoff_days(time: Column, before: Column) -> Column:
    """Whole days of elapsed time, not of the calendar."""
    return F.floor(F.timestamp_diff("MICROSECOND", before, time) / 86_400_000_000)


def one_cutoff_each(rows: DataFrame, group: str, cutoff: str) -> DataFrame:
    """Groups with more than one cutoff; must be empty."""
    return rows.groupBy(group).agg(F.countDistinct(cutoff).alias("cutoffs")).where("cutoffs > 1")


def scope_match(query: DataFrame, scopes: DataFrame, exact: Sequence[str], wild: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """To each query row the last scope row whose exact columns agree and whose wild columns agree or are null.

    Only the last scope row of each pattern can win, so the scopes are cut to one row a pattern first. Each query row then
    looks up one pattern for each set of wild columns that is left open (2 ** len(wild)), so no join fans out, however many
    scopes fit a row. Equal query rows come once.
    """
    names, keys = {c: f"__s_{c}" for c in dict.fromkeys([*exact, *wild, *order, *values])}, [*exact, *wild]
    rank, value = F.struct(*[names[c] for c in order]), F.struct(*[F.col(names[c]).alias(c) for c in values])
    s = scopes.select(*[F.col(c).alias(n) for c, n in names.items()])
    best = s.groupBy(*[names[c] for c in keys]).agg(F.max_by(F.struct(rank.alias("o"), value.alias("v")), rank).alias("__b"))
    out, found = query.distinct(), []
    for k, closed in enumerate(product((False, True), repeat=len(wild))):
        test = [F.col(names[c]).isNotNull() if shut else F.col(names[c]).isNull() for c, shut in zip(wild, closed, strict=True)]
        at = [*exact, *[c for c, shut in zip(wild, closed, strict=True) if shut]]
        one = best.where(reduce(and_, test, F.lit(True))).select(*[F.col(names[c]).alias(f"__{k}_{c}") for c in at], F.col("__b").alias(f"__b{k}"))
        out = out.join(one, [F.col(c) == F.col(f"__{k}_{c}") for c in at] or F.lit(True), "left")
        found.append(F.col(f"__b{k}"))
    last = F.array_max(F.array_compact(F.array(*found)))
    return out.select(*query.columns, last.alias("__b")).select(*query.columns, *[F.col("__b")["v"][v].alias(v) for v in values])
