"""Queries of scoreboard and price documents: a customer's orders as a scoreboard, its lines as contests; an order's lines as the items of its prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.queries import query
from tidemark.plans.tables import table
from tidemark.sources import scoreboards


def _drifted(body, key, name):
    """Of 17 documents one isn't JSON, one has no list, one lacks it, one has a number in it."""
    k = key % 17
    return F.when(k == 1, F.concat(F.lit("{"), body)).when(k == 2, F.lit(f'{{"{name}":{{}}}}')).when(k == 3, F.replace(body, F.lit(f'{{"{name}":'), F.lit('{"others":'))).when(k == 4, F.concat(F.substring(body, F.lit(1), F.length(body) - 2), F.lit(",5]}"))).otherwise(body)


def scoreboard_documents(spark, d):
    """doc, body. Some events are of another series, over or cancelled; some contests are cancelled, or a corner lacks a name."""
    line, order = table(spark, d, "lineitem"), table(spark, d, "orders")
    n = F.col("l_linenumber")
    corner = lambda at, number, name: F.struct(at.alias("order"), F.struct(number.alias("id"), name.alias("displayName")).alias("athlete"))
    a = corner((1 + n % 2).cast("int"), F.col("l_partkey"), F.concat(F.lit("P"), F.col("l_partkey")))
    b = corner((2 - n % 2).cast("int"), F.col("l_suppkey"), F.when(F.col("l_tax") > 0.01, F.concat(F.lit("S"), F.col("l_suppkey"))))
    status = F.struct(F.struct(F.when(F.col("l_discount") > 0.08, "STATUS_CANCELED").otherwise("STATUS_SCHEDULED").alias("name")).alias("type"))
    number = F.concat_ws("-", n, "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"))
    contest = F.struct(number.alias("id"), F.array(a, b).alias("competitors"), status.alias("status"), F.struct(F.col("l_returnflag").alias("text")).alias("type"))
    bouts = line.groupBy("l_orderkey").agg(F.collect_list(contest).alias("competitions"))
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Contender Series "), k)).when(k % 3 == 1, "DWCS Brazil").otherwise("Fight Night")
    event = F.struct(k.alias("id"), name.alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm'Z'").alias("date"), F.struct(F.struct((F.col("o_orderstatus") == "F").alias("completed")).alias("type")).alias("status"), "competitions")
    made = order.join(bouts, k == F.col("l_orderkey")).groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(event).alias("events"))).alias("body"))
    return made.select(F.col("o_custkey").alias("doc"), _drifted(F.col("body"), F.col("o_custkey"), "events").alias("body"))


_REASON = "CASE {0} % 17 WHEN 1 THEN 'not_json' WHEN 2 THEN '{1}_not_array' WHEN 3 THEN 'no_{1}' WHEN 4 THEN '{2}_not_object' END"
_EVENTS = _REASON.format("o_custkey", "events", "event")


@query(f"""SELECT o_custkey AS doc, CAST(o_orderkey AS VARCHAR) AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN 'dwcs' ELSE 'dwcs_brazil' END AS series, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS start,
    l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) AS competition_id, CASE WHEN l_linenumber % 2 = 0 THEN 'P' || l_partkey ELSE 'S' || l_suppkey END AS a_name, CASE WHEN l_linenumber % 2 = 0 THEN 'S' || l_suppkey ELSE 'P' || l_partkey END AS b_name, l_returnflag AS weight_class
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {_EVENTS} IS NULL AND o_orderkey % 3 < 2 AND o_orderstatus <> 'F' AND l_discount <= 0.08 AND l_tax > 0.01 AND l_partkey <> l_suppkey""")
def scoreboard_fights(spark, d):
    f = scoreboards.scheduled_fights(scoreboard_documents(spark, d), "doc", "body")
    return f.select("doc", "event_id", "series", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "competition_id", "a_name", "b_name", "weight_class")


@query(f"""SELECT o_custkey AS doc, {_EVENTS} AS reason FROM (SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE o_custkey % 17 BETWEEN 1 AND 4""")
def scoreboard_quarantine(spark, d):
    return scoreboards.scoreboard_quarantine(scoreboard_documents(spark, d), "doc", "body")


def odds_documents(spark, d):
    """doc, body: the first line's book is refused, odd lines write a price as a text, some lack one side."""
    line, n = table(spark, d, "lineitem"), F.col("l_linenumber")
    price = (100 + F.col("l_quantity")).cast("int")
    home = F.struct(F.when(n % 2 == 0, price.cast("string")).otherwise(F.concat(F.lit("+"), price)).alias("moneyLine"), F.struct(F.col("l_partkey").alias("id")).alias("athlete"))
    away = F.struct(F.struct(F.when(F.col("l_returnflag") != "R", -price).alias("moneyline")).alias("current"), F.col("l_suppkey").alias("athleteId"))
    provider = F.struct(F.when(n == 1, "Bet365").otherwise(F.concat(F.lit("Book "), n)).alias("name"))
    made = line.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct(provider.alias("provider"), home.alias("homeTeamOdds"), away.alias("awayTeamOdds"))).alias("items"))).alias("body"))
    return made.select(F.col("l_orderkey").alias("doc"), _drifted(F.col("body"), F.col("l_orderkey"), "items").alias("body"))


@query("""SELECT l_orderkey AS doc, 'book ' || l_linenumber AS bookmaker_key, s.side, CASE s.side WHEN 'home' THEN l_partkey ELSE l_suppkey END::VARCHAR AS athlete_id, CAST(100 + l_quantity AS INT) * CASE s.side WHEN 'home' THEN 1 ELSE -1 END AS american
  FROM lineitem, (VALUES ('home'), ('away')) s(side) WHERE l_linenumber > 1 AND l_returnflag <> 'R' AND l_orderkey % 17 NOT BETWEEN 1 AND 4""")
def scoreboard_prices(spark, d):
    return scoreboards.prices(odds_documents(spark, d), "doc", "body").select("doc", "bookmaker_key", "side", "athlete_id", "american")


@query(f"""SELECT l_orderkey AS doc, coalesce({_REASON.format("l_orderkey", "items", "item")}, CASE WHEN n > 0 THEN 'quoted' ELSE 'unknown' END) AS state, CASE WHEN l_orderkey % 17 BETWEEN 1 AND 4 THEN 0 ELSE n END AS n_quotes, CASE WHEN l_orderkey % 17 BETWEEN 1 AND 4 THEN 0 ELSE bad END AS n_refused
  FROM (SELECT l_orderkey, CAST(count(*) FILTER (l_linenumber > 1 AND l_returnflag <> 'R') AS INT) AS n, CAST(count(*) FILTER (l_linenumber = 1) AS INT) AS bad FROM lineitem GROUP BY 1)""")
def price_documents(spark, d):
    return scoreboards.price_documents(odds_documents(spark, d), "doc", "body")
