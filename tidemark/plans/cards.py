"""Queries of cards, totals, provider keys and price classes; pages are made from rows, and the SQL reads those rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import keys, odds
from tidemark.plans.queries import query
from tidemark.plans.tables import table
from tidemark.sources import cards


def _filled(page: str, **parts: Column) -> Column:
    """The page with each {name} replaced by an expression."""
    pieces = [page]
    for name, value in parts.items():
        pieces = [x for p in pieces for x in (_between(p.split("{%s}" % name), value) if isinstance(p, str) else [p])]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])


def _between(texts: list[str], value: Column) -> list:
    return [x for k, t in enumerate(texts) for x in ([value, t] if k else [t])]


CARD = """<table><thead><tr><th>W/L<th>Fighter</tr></thead><tbody>
<tr class="b-fight-details__table-row" data-link="http://x.example/fight-details/none"><td>no fight
<tr class="b-fight-details__table-row b-fight-details__table-row__hover" data-link="http://x.example/fight-details/f{order}?a=1">
<td class="b-fight-details__table-col"><p class="b-fight-details__table-text"><a class="b-flag {flag}" href="#"><i>win</i></a></p></td>
<td class="b-fight-details__table-col l-page_align_left"><p class="b-fight-details__table-text"><a href="http://x.example/fighter-details/a{customer}"> {clerk} </a></p>
<p class="b-fight-details__table-text"><a href="http://x.example/fighter-details/b{order}/">Ann &amp; Co</a></p></td>
<td class="b-fight-details__table-col l-page_align_left"><p class="b-fight-details__table-text">Women's <b>Strawweight</b></p></td>
<td class="b-fight-details__table-col l-page_align_left"><p class="b-fight-details__table-text">{method}</p></td>
<td class="b-fight-details__table-col"><p class="b-fight-details__table-text">{round}</p></td><td class="b-fight-details__table-col">3:45</td></tr></tbody></table>"""


@query("""SELECT o_orderkey, 0 AS pos, 'f' || o_orderkey AS fight_id, 'a' || o_custkey AS fighter_a_id, 'Name ' || o_custkey AS fighter_a_name, 'b' || o_orderkey AS fighter_b_id, 'Ann & Co' AS fighter_b_name,
  CASE WHEN o_orderstatus = 'F' THEN 'a' || o_custkey END AS winner_id, 'Women''s Strawweight' AS weight_class, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'U-DEC' WHEN '2' THEN 'KO / TKO' WHEN '3' THEN 'Odd Result' ELSE '' END AS method,
  CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 4 AS INT) END AS round, '3:45' AS time FROM orders""")
def card_fights(spark, d):
    o = table(spark, d, "orders")
    name = F.concat(F.lit("Name "), F.col("o_custkey").cast("string"))
    first = F.substring("o_orderpriority", 1, 1)
    method = F.when(first == "1", "U-DEC").when(first == "2", "KO / TKO").when(first == "3", "Odd Result").when(first == "4", "").otherwise(name)
    number = F.when(F.col("o_orderkey") % 4 > 0, (F.col("o_orderkey") % 4).cast("string")).otherwise("?")
    page = _filled(CARD, order=F.col("o_orderkey"), customer=F.col("o_custkey"), clerk=name, flag=F.when(F.col("o_orderstatus") == "F", cards.GREEN_FLAG).otherwise("b-flag_style_bordered"), method=method, round=number)
    return cards.fights(cards.read_marks(o.select("o_orderkey", page.alias("html")), "o_orderkey", "html"), "o_orderkey")


P = '<p class="b-fight-details__table-text">'
TOTALS = (
    '<div class="b-fight-details__person"><i class="b-fight-details__person-status {one}">W</i><a class="b-link b-fight-details__person-link" href="/fighter-details/a{key}">A</a></div>'
    '<div class="b-fight-details__person"><i class="b-fight-details__person-status {two}">L</i><a class="b-link b-fight-details__person-link" href="/fighter-details/b{key}">B</a></div>'
    "<table><thead><tr><th>Round</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table><table><thead><tr><th>Fighter</th><th>KD</th></tr></thead><tbody><tr>"
    f'<td>{P}<a href="/fighter-details/a{{key}}">A</a></p>{P}<a href="/fighter-details/b{{key}}">B</a></p></td><td>{P}1</p>{P}0</p></td><td>{P}{{n}} of 30</p>{P}---</p></td><td>{P}{{n}}%</p>{P}---</p></td>'
    f"<td>{P}4 of 9</p>{P}{{n}} of 31</p></td><td>{P}0 of 0</p>{P}1 of 2</p></td><td>{P}---</p>{P}50%</p></td><td>{P}2</p>{P}-</p></td><td>{P}0</p>{P}{{n}}</p></td><td>{P}1:0{{digit}}</p>{P}--</p></td></tr>"
    f"<tr><td>{P}<a href='/x'>other</a></p></td></tr></tbody></table>"
)


@query("""WITH c AS (SELECT c_custkey, CAST(c_nationkey AS INT) AS n, CAST(c_custkey % 10 AS INT) AS g FROM customer)
  SELECT c_custkey, 0 AS side, 'a' || c_custkey AS fighter_id, 'A' AS name, 1 AS kd, n AS sig_landed, 30 AS sig_attempted, CAST(n AS DOUBLE) / 100 AS sig_pct, 4 AS total_landed, 9 AS total_attempted, 0 AS td_landed, 0 AS td_attempted, CAST(NULL AS DOUBLE) AS td_pct, 2 AS sub_att, 0 AS rev, 60 + g AS ctrl_seconds FROM c
  UNION ALL SELECT c_custkey, 1, 'b' || c_custkey, 'B', 0, 0, 0, NULL, n, 31, 1, 2, 0.5, 0, n, 0 FROM c""")
def card_totals(spark, d):
    return cards.totals(_totals_pages(spark, d), "c_custkey")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a' || c_custkey WHEN 1 THEN 'b' || c_custkey END AS winner_id FROM customer""")
def card_winners(spark, d):
    return cards.winners(_totals_pages(spark, d), "c_custkey")


def _totals_pages(spark, d):
    key = F.col("c_custkey")
    mark = lambda k: F.when(key % 3 == k, "b-fight-details__person-status_style_green").otherwise("b-fight-details__person-status_style_gray")
    page = _filled(TOTALS, key=key, n=F.col("c_nationkey"), digit=key % 10, one=mark(0), two=mark(1))
    return cards.read_marks(table(spark, d, "customer").select("c_custkey", page.alias("html")), "c_custkey", "html")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN s + 37800 WHEN 1 THEN s + 30600 WHEN 2 THEN s WHEN 3 THEN s + 56700 END AS seconds, o_orderkey % 6 = 4 AS malformed
  FROM (SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 AS s FROM orders)""")
def utc_instants(spark, d):
    day = F.col("o_orderdate").cast("date")
    t = day.cast("string")
    k = F.col("o_orderkey") % 6
    seconds = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
    raw = F.when(k == 0, F.concat(t, F.lit("T10:30:00Z"))).when(k == 1, F.concat(F.lit(" "), t, F.lit(" 10:30:00+02:00"))).when(k == 2, seconds.cast("string")).when(k == 3, F.concat(t, F.lit("T10:30:00-0515"))).when(k == 4, F.concat(t, F.lit("T10:30:00"))).otherwise(" ")
    at = keys.utc_instant(raw)
    return table(spark, d, "orders").select("o_orderkey", F.unix_seconds(at["at"]).alias("seconds"), at["malformed"].alias("malformed"))


@query(f"""WITH h AS (SELECT c_custkey, sha1(unhex('{keys.NAMESPACE.replace("-", "")}') || encode('dwcs:fighter:espn:' || c_custkey)) AS h FROM customer)
  SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def canonical_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", keys.canonical_id("fighter", "espn", F.concat(F.lit(" "), F.col("c_custkey").cast("string"))).alias("id"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'gold' ELSE 'conflict' END AS tier, CASE o_orderstatus WHEN 'F' THEN 'decisive' WHEN 'O' THEN 'draw' ELSE '' END AS result, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS winner,
  CASE o_orderstatus WHEN 'F' THEN 'dwcs_brazil' WHEN 'O' THEN 'dwcs' END AS series, o_orderstatus <> 'O' AS alias, CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'fighter_a' WHEN 'O' THEN 'fighter_b' END WHEN o_orderstatus = 'P' THEN 'over' END AS outcome FROM orders""")
def provider_keys(spark, d):
    s = F.col("o_orderstatus")
    pick = lambda f, o, other: F.when(s == "F", f).when(s == "O", o).otherwise(other)
    key = keys.result_key(pick("decisive", "draw", None), F.col("o_orderpriority"))
    moneyline = F.col("o_orderkey") % 2 == 0
    outcome = keys.outcome_key(F.when(moneyline, "moneyline").otherwise("totals"), pick(" Home  One", "away", " Over "), F.lit("HOME one"), F.lit("Away"))
    return table(spark, d, "orders").select(
        "o_orderkey", keys.in_vocabulary(pick(" gold ", "Gold", None), keys.TIERS).alias("tier"), key["result"].alias("result"), key["winner"].alias("winner"),
        keys.series_of(pick("Contender  Series: Brazil 1", "x DWCS 4", "dwcsx")).alias("series"), keys.is_alias(pick(" Bet365", "bet365_uk", "BET365_AU ")).alias("alias"), outcome.alias("outcome"),
    )


@query("""WITH p AS (SELECT p_partkey, 0.1 + p_size / 100.0 AS p50, (0.1 + p_size / 100.0) * 0.96 AS p25, p_size % 2 = 0 AS exact, CASE WHEN p_partkey % 5 > 0 THEN 1.5 + (p_partkey % 7) END AS offered, (p_partkey % 11) / 10.0 AS sure, p_partkey % 13 > 0 AS gates FROM part)
  SELECT p_partkey, CASE WHEN NOT gates THEN 'no_bet' WHEN offered IS NULL THEN 'price_target' WHEN offered >= greatest(1 / p25, (1 + CASE WHEN exact THEN 0.10 ELSE 0.05 END) / p50) AND sure >= CASE WHEN exact THEN 0.75 ELSE 0.70 END THEN 'confirmed_value' ELSE 'no_bet' END AS state FROM p""")
def price_classes(spark, d):
    k, p50 = F.col("p_partkey"), 0.1 + F.col("p_size") / 100
    family = F.when(F.col("p_size") % 2 == 0, "exact_round").otherwise("moneyline")
    state = odds.price_class(p50, p50 * 0.96, family, k % 13 > 0, F.lit(True), F.when(k % 5 > 0, 1.5 + k % 7), (k % 11) / 10)
    return table(spark, d, "part").select("p_partkey", state.alias("state"))
