"""Pages, keys and price classes on small cases; names are invented."""

from __future__ import annotations

import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys, odds
from tidemark.sources import cards
from tidemark.streaming import ticks

P = '<p class="b-fight-details__table-text">'
ROW = '<tr class="b-fight-details__table-row b-fight-details__table-row__hover" data-link="http://x/fight-details/7"><td class="l-page_align_left">{people}</td><td class="l-page_align_left">{cells}</td><td class="b-fight-details__table-col">2</td><td class="b-fight-details__table-col"></td></tr>'
PEOPLE = f'{P}<a href="http://x/fighter-details/a1">Ko</a></p>{P}<a href="http://x/fighter-details/b2">Lee Law</a></p>'


def fight(spark, people=PEOPLE, *cells):
    html = "<table>" + ROW.format(people=people, cells="".join(f"{P}{c}</p>" for c in cells)) + "</table>"
    return cards.fights(cards.read_marks(spark.createDataFrame([(1, html)], "k long, html string"), "k", "html"), "k").collect()


@pytest.mark.parametrize(("cells", "method", "weight"), [(("Flyweight", "SUB"), "SUB", "Flyweight"), (("W", "Flyweight", "Strange"), "Strange", "Flyweight"), (("Strange", "u-dec"), "u-dec", ""), (("W",), "", ""), ((), "", "")])
def test_method_and_weight_cells(spark, cells, method, weight):
    (row,) = fight(spark, PEOPLE, *cells)
    assert (row.method, row.weight_class, row.round, row.time, row.winner_id, row.fight_id) == (method, weight, 2, None, None, "7")


def test_a_name_is_never_the_method(spark):
    (row,) = fight(spark, PEOPLE, "KO")  # the first fighter is called so
    assert row.method == "" and row.fighter_a_name == "Ko"


def test_a_row_with_one_fighter_is_no_fight(spark):
    assert fight(spark, f'{P}<a href="http://x/fighter-details/a1">Ko</a></p>', "SUB") == []


def test_pages_without_parts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<table><tr><td>x"), (4, "<table><thead><tr><th>Fighter<th>KD</table>")], "k long, html string")
    marks = cards.read_marks(df, "k", "html")
    assert cards.fights(marks, "k").count() == cards.totals(marks, "k").count() == 0
    assert [r.winner_id for r in cards.winners(marks, "k").collect()] == [None] * 4
    assert cards.fights(cards.read_marks(df.limit(0), "k", "html"), "k").count() == 0


def test_ids_are_those_of_the_standard(spark):
    names = ["", " 12 ", "é", "x" * 300]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", keys.canonical_id("bout", "espn", F.col("n")).alias("id")).collect()
    assert all(r.id == str(uuid.uuid5(uuid.UUID(keys.NAMESPACE), f"dwcs:bout:espn:{r.n.strip(' ')}")) for r in got)


@pytest.mark.parametrize(("raw", "seconds", "malformed"), [("2024-01-02T03:04:05Z", 1704164645, False), ("2024-01-02 03:04+01:00", 1704161040, False), ("1704164645", 1704164645, False), ("2024-01-02T03:04:05", None, True), ("2024-13-02T03:04:05Z", None, True), ("soon", None, True), (" ", None, False), (None, None, False)])
def test_instants_need_an_offset(spark, raw, seconds, malformed):
    at = keys.utc_instant(F.lit(raw).cast("string"))
    assert tuple(spark.range(1).select(F.unix_seconds(at["at"]), at["malformed"]).first()) == (seconds, malformed)


@pytest.mark.parametrize(("gates", "offered", "sure", "state"), [(True, 2.1, 0.7, "confirmed_value"), (True, 2.09, 0.7, "no_bet"), (True, 2.1, 0.69, "no_bet"), (True, 2.1, None, "no_bet"), (True, None, None, "price_target"), (False, 9.0, 1.0, "no_bet"), (None, 9.0, 1.0, "no_bet")])
def test_price_classes_have_closed_edges(spark, gates, offered, sure, state):
    d = lambda x: F.lit(x).cast("double")
    got = odds.price_class(d(0.5), d(0.5), F.lit("moneyline"), F.lit(gates).cast("boolean"), F.lit(True), d(offered), d(sure))
    assert spark.range(1).select(got).first()[0] == state


def test_lifecycle_is_in_time_order_across_arrow_batches(spark, tmp_path):
    """More rows of a key than an Arrow batch holds, written newest first."""
    rows = [(1, datetime(2024, 1, day), ("active", "suspended")[day % 2]) for day in range(20, 1, -1)] + [(1, datetime(2024, 1, 1), "active")]
    spark.createDataFrame(rows, "k long, at timestamp, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    got: list = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = ticks.lifecycle(spark.readStream.schema("k long, at timestamp, v string").parquet(str(tmp_path / "in")), "k", "at", "v")
        out.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got.sort(key=lambda r: r.at)
    assert len(got) == 20 and [r.before for r in got[1:]] == [r.state for r in got[:-1]] and all(r.allowed for r in got)
