"""Winners, clocks, classes and quotas on small cases."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import versions

TWO = [("a", False), ("b", False)]


@pytest.mark.parametrize(
    ("kind", "result", "winner", "people", "expected"),
    [
        ("event_night", "decisive", " a ", TWO, ("a", "named", None)),
        ("event_night", "decisive", None, [("a", True), ("b", False)], (None, None, "missing_decisive_winner")),
        ("current", "decisive", None, [("a", True), ("b", False)], ("a", "flag", None)),
        ("current", "decisive", "b", [("a", True), ("b", False)], (None, None, "flag_winner_contradiction")),
        ("current", "decisive", "c", TWO, (None, None, "nonparticipant_winner")),
        ("current", "decisive", "a", [("a", True), ("b", True)], (None, None, "duplicate_winner_flag")),
        ("current", "draw", None, TWO, (None, "none", None)),
        ("current", "no_contest", None, [("a", True), ("b", False)], (None, None, "non_decisive_has_winner")),
        ("current", "decisive", "a", [("a", False)], (None, None, "invalid_participant_set")),
        ("current", "decisive", "a", [("a", False), (None, False)], (None, None, "missing_participant_id")),
        ("current", "decisive", "a", None, (None, None, "invalid_participant_set")),
        ("current", None, "a", TWO, (None, None, "unknown_result_class")),
    ],
)
def test_winners(spark, kind, result, winner, people, expected):
    df = spark.createDataFrame([(kind, result, winner, people)], "k string, r string, w string, p array<struct<id:string,flagged:boolean>>")
    assert tuple(df.select(versions.winner_of(F.col("k"), F.col("r"), F.col("w"), F.col("p")).alias("x")).select("x.*").first()) == expected


def test_clocks_come_from_the_linked_observation_only(spark):
    t = datetime(2024, 1, 1)
    seen = spark.createDataFrame([(1, "direct", None, t, None)], "id long, timestamp_quality string, proxy_published_at timestamp, source_published_at timestamp, source_updated_at timestamp")
    mine = spark.createDataFrame([("x", 1, "linked"), ("y", 1, "unknown"), ("z", 2, "linked"), ("n", None, "linked")], "v string, raw_observation_id long, provenance_status string")
    got = {r.v: (r.timestamp_quality, r.source_published_at) for r in versions.attach_clocks(mine, seen).collect()}
    assert got == {"x": ("direct", t), "y": ("unknown", None), "z": ("unknown", None), "n": ("unknown", None)}


@pytest.mark.parametrize(("at", "left", "state"), [("2024-01-16 11:00:00", 5, "persisted_quota_observation"), ("2024-01-15 12:00:00", 0, "persisted_quota_observation"), ("2024-01-15 11:59:59.5", 5, "stale_max_age"), ("2023-12-31 23:00:00", 5, "stale_billing_cycle"), ("2024-01-16 11:00:00", -1, "malformed_negative_remaining"), ("2024-01-16 11:00:00", None, "missing_remaining_header")])
def test_remaining_quota(spark, at, left, state):
    cut = F.lit("2024-01-16 12:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame([("p", 1, left), ("p", 2, 99)], "provider string, id long, left int").withColumn("at", F.when(F.col("id") == 1, F.lit(at)).otherwise("2024-01-16 12:00:01").cast("timestamp_ntz"))
    row = versions.remaining_quota(df, "provider", "at", "id", "left", cut, 86400).first()
    assert (row.state, row.remaining) == (state, left if state.startswith("persisted") else None)


def test_fingerprint_scope_without_clocks_or_cutoff(spark):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    got = spark.range(1).select(
        versions.in_fingerprint(t(None), t(None), t("2024-01-01")), versions.in_fingerprint(t("2025-01-01"), t("2025-01-01"), t(None)), versions.in_fingerprint(t("2024-01-01"), t(None), t("2024-01-01")), versions.in_fingerprint(t(None), t("2024-01-01"), t("2024-01-01"))
    ).first()
    assert tuple(got) == (True, True, False, True)
