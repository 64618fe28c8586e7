"""Result versions and their evidence: clocks, winners, classes, remaining quota. What is refused carries a reason, no row is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closed vocabularies and the order of jobs (fixed values).
JOBS = ("discover", "ingest-history", "identity", "snapshot-odds", "score", "recommend", "publish", "results", "grade", "reconcile-24h", "reconcile-7d", "retrain", "backup")
STATUSES = ("occurred", "completed", "cancelled", "canceled", "replacement")
CLOCKS = ("timestamp_quality", "proxy_published_at", "source_published_at", "source_updated_at")


def fact_visible_at(published: Column, updated: Column, proxy: Column) -> Column:
    """The clock of a fact: publication, else update, else a documented proxy; never when it was acquired."""
    return F.coalesce(published, updated, proxy)


def in_fingerprint(effective: Column, observed: Column, cutoff: Column) -> Column:
    """Whether a row counts in a fingerprint at a cutoff: in force before it, or seen by then, or without both clocks; without a cutoff all do."""
    known = F.coalesce(effective < cutoff, F.lit(False)) | F.coalesce(observed <= cutoff, F.lit(False))
    return cutoff.isNull() | known | (effective.isNull() & observed.isNull())


def attach_clocks(versions: DataFrame, observations: DataFrame, link: str = "raw_observation_id", status: str = "provenance_status", observation_id: str = "id") -> DataFrame:
    """versions with CLOCKS of the very observation they are linked to; without one the quality is unknown and the clocks null.

    observation_id is unique. Versions without a link take no part in the join, so their null keys make no hot group.
    """
    mine = F.when(F.col(status) == "linked", F.col(link))
    clocks = observations.select(F.col(observation_id).alias("__o"), F.struct(*CLOCKS).alias("__c"))
    kept = [c for c in versions.columns if c not in CLOCKS]
    joined = versions.select(*kept, mine.alias("__l")).join(clocks, F.col("__l") == F.col("__o"), "left")
    quality = F.when(F.col("__o").isNull(), "unknown").otherwise(F.col("__c.timestamp_quality"))
    return joined.select(*kept, quality.alias("timestamp_quality"), *[F.col(f"__c.{c}").alias(c) for c in CLOCKS[1:]])


def winner_of(kind: Column, result: Column, winner: Column, participants: Column) -> Column:
    """A struct of winner, source and refused (a reason, null if valid); participants are structs of id and flagged.

    A decisive result names one of two participants. A flag never overrides a named winner: on a contradiction the row is
    refused; alone it decides only the current version. Draws and no contests have neither.
    """
    named = F.nullif(F.trim(winner), F.lit(""))
    ids = F.transform(participants, lambda p: F.coalesce(F.trim(p["id"]), F.lit("")))
    flags = F.transform(F.filter(participants, lambda p: F.coalesce(p["flagged"], F.lit(False))), lambda p: F.trim(p["id"]))
    flag = F.get(flags, 0)
    flagged = F.size(flags)
    open_result = result.isin("draw", "no_contest")
    no = F.lit(False)
    refused = (
        F.when(~F.coalesce(result.isin("decisive", "draw", "no_contest"), no), "unknown_result_class")
        .when(F.coalesce(F.array_contains(ids, ""), no), "missing_participant_id")
        .when(participants.isNull() | (F.size(ids) != 2) | (F.size(F.array_distinct(ids)) != 2), "invalid_participant_set")
        .when(open_result & (named.isNotNull() | (flagged > 0)), "non_decisive_has_winner")
        .when(open_result, None)
        .when(flagged > 1, "duplicate_winner_flag")
        .when(named.isNull() & ((kind == "event_night") | (flagged == 0)), "missing_decisive_winner")
        .when(named.isNotNull() & ~F.array_contains(ids, named), "nonparticipant_winner")
        .when(named.isNotNull() & (flagged == 1) & (flag != named), "flag_winner_contradiction")
    )
    valid = refused.isNull()
    source = F.when(valid, F.when(open_result, "none").when(named.isNotNull(), "named").otherwise("flag"))
    return F.struct(F.when(valid & ~open_result, F.coalesce(named, flag)).alias("winner"), source.alias("source"), refused.alias("refused"))


def manifest_class(series: Column, status: Column, provider_id: Column, blocked: Column) -> Column:
    """A struct of category, lifecycle and provider of a manifest's row; null categories where a value is out of its vocabulary."""
    s = F.lower(F.trim(status))
    valid = F.coalesce(series.isin("standard", "brazil") & s.isin(*STATUSES), F.lit(False))
    lifecycle = F.when(s.isin("cancelled", "canceled"), "cancelled").when(s == "replacement", "replacement").otherwise("completed")
    category = F.when(lifecycle == "completed", F.concat(F.lit("completed_"), series)).otherwise(lifecycle)
    provider = F.when(F.trim(F.coalesce(provider_id, F.lit(""))) != "", "resolved").when(blocked, "blocked").otherwise("unmapped")
    return F.struct(F.when(valid, category).alias("category"), F.when(valid, lifecycle).alias("lifecycle"), provider.alias("provider"))


def remaining_quota(observations: DataFrame, provider: str, at: str, row_id: str, remaining: str, as_of: Column, max_age: int) -> DataFrame:
    """(provider, remaining, state): each provider's newest observation at or before as_of, unless it is of another month, older than max_age seconds, absent or negative."""
    newest = F.max_by(F.struct(F.col(at).alias("at"), F.col(remaining).alias("left")), F.struct(F.col(at), F.col(row_id)))
    last = observations.where(F.col(at) <= as_of).groupBy(provider).agg(newest.alias("o"))
    left, seen = F.col("o.left"), F.col("o.at")
    month = lambda c: F.date_trunc("month", c)
    age = F.timestamp_diff("MICROSECOND", seen, as_of)
    state = F.when(month(seen) != month(as_of), "stale_billing_cycle").when(age > max_age * 1_000_000, "stale_max_age").when(left.isNull(), "missing_remaining_header").when(left < 0, "malformed_negative_remaining").otherwise("persisted_quota_observation")
    return last.select(provider, F.when(state == "persisted_quota_observation", left).alias("remaining"), state.alias("state"))


def job_order(job: Column, event: Column, bout: Column, key: Column) -> list[Column]:
    """The order in which due jobs run: by their kind, unknown kinds last, then event, bout and key."""
    place = F.array_position(F.array(*map(F.lit, JOBS)), job)
    return [F.when(F.coalesce(place, F.lit(0)) == 0, 999).otherwise(place), F.coalesce(event, F.lit("")), F.coalesce(bout, F.lit("")), key]
