"""Scoreboard and price documents as VARIANT: what is absent is told apart from what has another kind than it should.

A document is judged and opened within its row, without a shuffle. One whose shape has drifted is set aside whole, with
the first reason; what a reader may pass over (other series, contests that are over, an incomplete pair) is passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import keys

ARRAY, OBJECT = "array<variant>", "map<string,variant>"
# States of events and contests that are not to come.
OVER = ("STATUS_FINAL", "STATUS_COMPLETED", "STATUS_CANCELLED", "STATUS_CANCELED", "STATUS_POSTPONED")
OVER_STATES = ("post", "final")
BLANKS = " \t\n\v\f\r"
PRICES = ("moneyLine", "moneyline", "money_line")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """What is made of a value that is needed more than once: within a lambda each mention of an expression is worked out anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _is(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind).isNotNull()


def _odd(v: Column, path: str, kind: str) -> Column:
    """There, not null, and of another kind."""
    at = _get(v, path, "variant")
    return at.isNotNull() & ~F.is_variant_null(at) & ~_is(at, kind)


def _text(v: Column, *paths: str) -> Column:
    """The first of the paths that holds a text, trimmed; else empty."""
    return F.coalesce(*[F.trim(F.nullif(_get(v, p), F.lit("")), F.lit(BLANKS)) for p in paths], F.lit(""))


def _instant(text: Column) -> Column:
    """An ISO text; without an offset it is UTC. Null if it is none."""
    t = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00"))).otherwise(text)
    return keys.utc_instant(F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z"))))["at"]


def _to_come(v: Column) -> Column:
    """By its status: neither completed nor cancelled, nor in a state that is past. Without a status it is to come."""
    done = _get(v, "status.type.completed", "variant")
    name, state = F.upper(_text(v, "status.type.name")), F.lower(_text(v, "status.type.state"))
    return ~((F.coalesce(F.schema_of_variant(done) == "BOOLEAN", F.lit(False)) & F.coalesce(F.try_variant_get(done, "$", "boolean"), F.lit(False))) | name.isin(*OVER) | name.contains("CANCEL") | state.isin(*OVER_STATES))


def _list_reason(v: Column, name: str, item: str) -> Column:
    """Why a document isn't an object with a list of objects under a name."""
    odd = lambda l: F.when(l.isNull(), f"{name}_not_array").when(F.exists(l, lambda i: ~F.coalesce(_is(i, OBJECT), F.lit(False))), f"{item}_not_object")
    return F.when(v.isNull(), "not_json").when(_get(v, name, "variant").isNull(), f"no_{name}").otherwise(_with(_get(v, name, ARRAY), odd))


def _event_reason(e: Column) -> Column:
    """Kinds that an event of the series must have where it says anything."""
    bouts = F.coalesce(_get(e, "competitions", ARRAY), F.array().cast(ARRAY))
    bouts = F.filter(bouts, lambda c: _is(c, OBJECT))
    pair = lambda c: F.coalesce(_get(c, "competitors", ARRAY), F.array().cast(ARRAY))
    return (
        F.when(_odd(e, "status", OBJECT) | _odd(e, "status.type", OBJECT), "status_not_object")
        .when(_odd(e, "competitions", ARRAY), "competitions_not_array")
        .when(F.exists(bouts, lambda c: _odd(c, "status", OBJECT) | _odd(c, "status.type", OBJECT)), "status_not_object")
        .when(F.exists(bouts, lambda c: _odd(c, "competitors", ARRAY)), "competitors_not_array")
        .when(F.exists(bouts, lambda c: F.exists(pair(c), lambda s: ~_is(s, OBJECT))), "competitor_not_object")
        .when(F.exists(bouts, lambda c: F.exists(pair(c), lambda s: _odd(s, "order", "int"))), "order_not_number")
    )


def _opened(docs: DataFrame, body: str) -> DataFrame:
    return docs.withColumn("__v", F.try_parse_json(body))


def scoreboard_reasons(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, reason: null for a document that can be read."""
    v = F.col("__v")
    series = F.filter(_get(v, "events", ARRAY), lambda e: keys.series_of(_text(e, "name", "shortName")).isNotNull())
    nested = F.get(F.filter(F.transform(series, _event_reason), lambda x: x.isNotNull()), F.lit(0))
    return _opened(docs, body).select(key, F.coalesce(_list_reason(v, "events", "event"), nested).alias("reason"), "__v")


def scoreboard_quarantine(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, reason of the documents that are set aside: not JSON (null bodies too), no list of events, or something of a wrong kind in an event of the series."""
    return scoreboard_reasons(docs, key, body).where("reason IS NOT NULL").select(key, "reason")


def scheduled_fights(docs: DataFrame, key: str, body: str) -> DataFrame:
    """A row for each contest to come of the series' events, with its card: key, event_id, name, start, location, series, competition_id, a_id, a_name, b_id, b_name, weight_class, fight_start.

    Corners go by order, then id. A contest needs an id and two different named athletes, an event an id and a start.
    An event that a document holds twice comes twice.
    """
    good = scoreboard_reasons(docs, key, body).where("reason IS NULL")
    e, c = F.col("e"), F.col("c")
    events = good.select(key, F.explode(_get(F.col("__v"), "events", ARRAY)).alias("e")).withColumn("name", _text(e, "name", "shortName")).withColumn("series", keys.series_of(F.col("name")))
    events = events.where(F.col("series").isNotNull() & _to_come(e)).select(key, "name", "series", _text(e, "id").alias("event_id"), _instant(_text(e, "date")).alias("start"), F.filter(_get(e, "competitions", ARRAY), lambda x: _is(x, OBJECT)).alias("bouts"))
    place = F.array(*[_text(F.get("bouts", F.lit(0)), f"venue.{p}") for p in ("fullName", "address.city", "address.state", "address.country")])
    events = events.where("event_id <> '' AND start IS NOT NULL").withColumn("location", F.array_join(F.filter(place, lambda x: x != ""), ", "))
    side = lambda s: F.struct(F.coalesce(_get(s, "order", "int"), F.lit(0)).alias("order"), _text(s, "id").alias("own"), _text(s, "athlete.id", "id").alias("id"), _text(s, "athlete.displayName", "athlete.fullName", "athlete.shortName").alias("name"))
    bouts = events.select(key, "event_id", "name", "start", "location", "series", F.explode("bouts").alias("c")).where(_to_come(c))
    bouts = bouts.withColumn("sides", F.array_sort(F.transform(_get(c, "competitors", ARRAY), side))).where(F.size("sides") == 2)
    a, b = F.get("sides", F.lit(0)), F.get("sides", F.lit(1))
    found = bouts.select(key, "event_id", "name", "start", "location", "series", _text(c, "id").alias("competition_id"), a["id"].alias("a_id"), a["name"].alias("a_name"), b["id"].alias("b_id"), b["name"].alias("b_name"), F.nullif(_text(c, "type.text", "type.abbreviation"), F.lit("")).alias("weight_class"), _instant(_text(c, "date", "startDate")).alias("fight_start"))
    return found.where("competition_id <> '' AND a_id <> '' AND b_id <> '' AND a_id <> b_id AND a_name <> '' AND b_name <> ''")


def _american(at: Column) -> Column:
    """A whole number, as a number (cut to whole) or as a text."""
    whole = lambda text: F.when(text.rlike(r"^[+-]?\d+$"), F.ltrim(text, F.lit("+")).try_cast("int"))
    part = lambda kind: kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    read = lambda kind: F.when(kind == "BIGINT", F.try_variant_get(at, "$", "int")).when(part(kind), F.try_variant_get(at, "$", "double").cast("int")).otherwise(_with(F.trim(F.try_variant_get(at, "$", "string"), F.lit(BLANKS)), whole))
    return F.when(at.isNotNull(), _with(F.schema_of_variant(at), read))


def _side(item: Column, *names: str) -> Column:
    """Of the first name that holds something its athlete and price; the price may stand under `current`."""
    full = lambda at: F.when(at.isNotNull() & ~F.is_variant_null(at) & (F.coalesce(F.size(F.try_variant_get(at, "$", OBJECT)), F.lit(1)) != 0), at)
    price = lambda at: F.coalesce(*[_with(_get(at, f"{top}{p}", "variant"), _american) for top in ("", "current.") for p in PRICES])
    own = lambda at: F.struct(F.nullif(_text(at, "athlete.id", "athleteId"), F.lit("")).alias("athlete_id"), price(at).alias("american"))
    return _with(F.coalesce(*[_with(_get(item, n, "variant"), full) for n in names]), own)


def _item(i: Column) -> Column:
    title = F.coalesce(F.nullif(_text(i, "provider.name", "provider.displayName"), F.lit("")), F.lit("espn"))
    book = _with(title, lambda t: F.struct(t.alias("title"), keys.bookmaker_key(F.coalesce(F.nullif(_text(i, "provider.id"), F.lit("")), t)).alias("key")))
    home, away = _side(i, "homeTeamOdds", "homeOdds"), _side(i, "awayTeamOdds", "awayOdds")
    return _with(book, lambda b: F.struct(b["key"].alias("bookmaker_key"), b["title"].alias("title"), (keys.is_alias(b["key"]) | keys.is_alias(b["title"])).alias("refused"), home.alias("home"), away.alias("away")))


def _priced(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, reason, items; without items where there is a reason."""
    v = F.col("__v")
    judged = _opened(docs, body).select(key, _list_reason(v, "items", "item").alias("reason"), "__v")
    return judged.select(key, "reason", F.when(F.col("reason").isNull(), F.transform(_get(v, "items", ARRAY), _item)).alias("items"))


def _complete(i: Column) -> Column:
    return ~i["refused"] & i["home"]["american"].isNotNull() & i["away"]["american"].isNotNull()


def price_documents(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, state, n_quotes, n_refused: quoted, unknown (nothing usable, which isn't a price of nobody), or the reason why the document is set aside."""
    n = lambda test: F.coalesce(F.size(F.filter("items", test)), F.lit(0))
    there, bad = n(_complete), F.col("reason").isNotNull()
    return _priced(docs, key, body).select(key, F.when(bad, F.col("reason")).when(there > 0, "quoted").otherwise("unknown").alias("state"), F.when(bad, 0).otherwise(there).alias("n_quotes"), F.when(bad, 0).otherwise(n(lambda i: i["refused"])).alias("n_refused"))


def prices(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, bookmaker_key, title, side, athlete_id, american: both sides of each item that has both; refused books never."""
    # outer: a filter on the reason, or on the list's length, would have each document read a second time below
    rows = _priced(docs, key, body).select(key, F.explode_outer(F.filter("items", _complete)).alias("i")).where("i IS NOT NULL")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"i.{s}.athlete_id").alias("athlete_id"), F.col(f"i.{s}.american").alias("american")) for s in ("home", "away")])
    return rows.select(key, F.col("i.bookmaker_key").alias("bookmaker_key"), F.col("i.title").alias("title"), F.inline(sides))
