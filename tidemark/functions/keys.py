"""Provider keys, instants, deterministic ids and closed vocabularies as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabularies, each with what stands for any other value (fixed values).
TIERS = (("missing", "bronze", "silver", "gold", "conflict"), "conflict")
RESULTS = (("decisive", "draw", "no_contest"), "missing")
TIME_QUALITIES = (("unknown", "publication_proxy", "revision_snapshot", "direct_source_timestamp"), "unknown")
ALIASES = ("bet365", "bet365_au")
SERIES = r"(?i)contender\s+series|dana\s+white.?s\s+contender|\bdwcs\b"
NAMESPACE = "6b897d0a-9b84-5863-8620-b9f1f75204a1"


def in_vocabulary(value: Column, vocabulary: tuple[Sequence[str], str]) -> Column:
    """The trimmed value if it is one of them, else what stands for others."""
    known, other = vocabulary
    return F.when(F.trim(value).isin(*known), F.trim(value)).otherwise(other)


def result_key(result: Column, winner: Column) -> Column:
    """A struct of result and winner; only a decisive result has a winner."""
    result = F.coalesce(result, F.lit(""))
    return F.struct(result.alias("result"), F.when(result == "decisive", F.coalesce(winner, F.lit(""))).otherwise("").alias("winner"))


def bookmaker_key(raw: Column) -> Column:
    return F.lower(F.trim(raw))


def is_alias(raw: Column, aliases: Sequence[str] = ALIASES) -> Column:
    """Only for the explicit aliases, never by prefix."""
    return bookmaker_key(raw).isin(*aliases)


def outcome_key(family: Column, outcome: Column, home: Column, away: Column) -> Column:
    """fighter_a for the home name and fighter_b for the away name of a moneyline, over or under of totals, else null."""
    name = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    o = name(outcome)
    side = F.when(o == name(home), "fighter_a").when(o == name(away), "fighter_b")
    return F.when(o == "", None).when(family == "moneyline", side).when((family == "totals") & o.isin("over", "under"), o)


def series_of(name: Column) -> Column:
    """The series of an event's name, null for others."""
    return F.when(name.rlike(SERIES), F.when(name.rlike(r"(?i)\bbrazil\b"), "dwcs_brazil").otherwise("dwcs"))


def utc_instant(raw: Column) -> Column:
    """A struct of at and malformed: ISO texts with an offset, or seconds since 1970. Blank is null; a text without an offset is malformed."""
    t = F.trim(raw)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"), F.regexp_replace(F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"([T ]\d{2}:\d{2})([Z+-])", "$1:00$2")).try_cast("timestamp")
    at = F.when(t.rlike(r"^\d+$"), F.timestamp_seconds(t.try_cast("bigint"))).otherwise(iso)
    blank = t.isNull() | (t == "")
    return F.struct(at.alias("at"), (~blank & at.isNull()).alias("malformed"))


def name_uuid(name: Column, namespace: str = NAMESPACE) -> Column:
    """The version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda start, n: F.substring(h, start, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def canonical_id(kind: str, source: str, external: Column) -> Column:
    """The id of an entity by its source's id; never by name."""
    return name_uuid(F.concat(F.lit(f"dwcs:{kind}:{source}:"), F.trim(external)))
