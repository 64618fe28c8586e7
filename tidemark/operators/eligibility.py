"""Whether a quote may be priced: five as-of lookups, then one ladder; and how provider events find their bouts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import as_of_join
from tidemark.operators.quotes import is_stale, unknown_blocks

TERMINAL = ("replaced", "cancelled", "closed", "locked")
BLOCKING_SELECTION = ("suspended", "removed", "locked")


def ladder(quote: Mapping[str, Column], as_of: Column, stale_minutes: int = 360) -> Column:
    """The first reason against a quote, null if there is none.

    quote: observed_at, updated_at, lower (of the alias), alias_bout, match_status, match_bout, caller_status,
    caller_bout, bout_state, selection_state, unknown_at, availability.
    """
    q = quote
    seen = (q["observed_at"] <= as_of) & (q["lower"].isNull() | (q["observed_at"] >= q["lower"])) & (q["updated_at"].isNull() | (q["updated_at"] <= as_of))
    fresh = F.coalesce(q["updated_at"], q["observed_at"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~yes(seen), "not_visible")
        .when(q["alias_bout"].isNull() | q["match_status"].isNull(), "unmatched")
        .when(q["match_status"] != "matched", "latest_match_not_matched")
        .when(~q["match_bout"].eqNullSafe(q["alias_bout"]), "alias_bout_mismatch")
        .when(yes((F.trim(q["caller_status"]) != "") & (F.trim(q["caller_status"]) != "matched")), "caller_match_restrict")
        .when(yes(q["caller_bout"] != q["alias_bout"]), "alias_bout_mismatch")
        .when(yes(q["bout_state"].isin(*TERMINAL)), "bout_terminal")
        .when(yes(q["selection_state"].isin(*BLOCKING_SELECTION)), "selection_locked")
        .when(unknown_blocks(q["unknown_at"], fresh), "market_unknown")
        .when(~yes(q["availability"] == "available"), "quote_unavailable")
        .when(is_stale(fresh, as_of, stale_minutes), "stale")
    )


def with_states(quotes: DataFrame, key: list[str], at: str, lookups: Mapping[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Adds to each quote, for each name, the value that held for its key at its time: name -> (facts, time, value, tie)."""
    out = quotes
    for name, (facts, time, value, tie) in lookups.items():
        right = facts.select(*key, F.col(time).alias("__at"), F.col(value).alias(name), F.col(tie).alias("__tie_"))
        out = as_of_join(out, right, key, at, "__at", [name], "__tie_")
    return out


def match_events(events: DataFrame, bouts: DataFrame, minutes: int = 30) -> DataFrame:
    """(event, status, bout, candidates): provider events find bouts by the unordered pair of names within the window, both ends included, in whole seconds.

    Time is cut into cells that are a second longer than the window, as parts of a second don't count against it; each
    event looks into three, so that the join is by equality. One candidate is matched, several are ambiguous, none
    unmatched. events: event, left, right, at; bouts: bout, left, right, at.
    """
    pair = lambda p: F.array_sort(F.array(F.lower(F.trim(f"{p}left")), F.lower(F.trim(f"{p}right"))))
    width = (60 * minutes + 1) * 1_000_000
    since = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    cell = lambda c: since(c) - F.pmod(since(c), F.lit(width))  # noqa: E731  (where it begins)
    e = events.select("event", pair("").alias("pair"), F.col("at").alias("e_at"), F.explode(F.transform(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)]), lambda x: cell(F.col("at")) + x * width)).alias("cell"))
    b = bouts.select("bout", pair("").alias("pair"), F.col("at").alias("b_at"), cell(F.col("at")).alias("cell"))
    near = F.abs(F.timestamp_diff("SECOND", F.col("e_at"), F.col("b_at"))) <= 60 * minutes
    hits = e.join(b, ["pair", "cell"]).where(near & (F.get("pair", 0) != F.get("pair", 1))).groupBy("event").agg(F.countDistinct("bout").alias("candidates"), F.min("bout").alias("one"))
    out = events.select("event").join(hits, "event", "left")
    n = F.coalesce("candidates", F.lit(0))
    return out.select("event", F.when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("unmatched").alias("status"), F.when(n == 1, F.col("one")).alias("bout"), n.alias("candidates"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def line_movement(events: DataFrame, key: str, time: str, tie: str, kind: str, payload: str) -> DataFrame:
    """Per publication: the last known movement (delta, else new minus old), freshness, and how many card changes."""
    new, old, delta = (F.get_json_object(payload, f"$.{k}").try_cast("double") for k in ("new_decimal", "old_decimal", "delta"))
    lines = F.col(kind).isin("line_change", "stale_line")
    moved = F.when(lines, F.coalesce(delta, new - old))
    return events.groupBy(key).agg(
        F.max_by(moved, F.when(moved.isNotNull(), F.struct(time, tie))).alias("movement"),
        F.when(F.bool_or(F.col(kind) == "stale_line"), "stale").when(F.bool_or(lines), "fresh").otherwise("unknown").alias("freshness"),
        F.count_if(F.col(kind) == "card_change").alias("card_changes"),
    )
