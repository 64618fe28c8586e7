"""What few rows of the driver's small tables show: queries against their SQL over planted rows, and joins that must not fan out."""

from __future__ import annotations

import os
import re
import threading
import time
import uuid
from datetime import datetime

import duckdb
import pytest

from compare import rows
from tidemark.operators import asof, grading, ledger
from tidemark.plans import audits, boards, cards, evidence, fits, grades, ingests, more, people, publications, walks  # noqa: F401
from tidemark.plans.queries import QUERIES, SQL
from tidemark.sources import gradebook, ingest, releases, scoreboards


def matches(spark, folder, name, **tables) -> bool:
    """Whether a query and its SQL agree over tables, each a query of DuckDB's."""
    con = duckdb.connect()
    for table, made in tables.items():
        con.execute(f"COPY ({made}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return rows(QUERIES[name](spark, str(folder)).toArrow()) == rows(con.sql(SQL[name]).to_arrow_table())


def within(spark, seconds, action):
    """The action's result; its jobs are cancelled, which is an error, after a time."""
    sc, group = spark.sparkContext, f"within-{uuid.uuid4().hex}"
    sc.setJobGroup(group, "a test", interruptOnCancel=True)
    timer = threading.Timer(seconds, sc.cancelJobGroup, [group])
    timer.start()
    try:
        return action()
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_the_last_scope_is_found_without_all_pairs(spark):
    """40,000 rows and as many scopes that fit them all: 1.6 billion pairs."""
    n = 40_000
    query = spark.range(n).selectExpr("id", "'F' AS s", "CASE WHEN id % 4 < 3 THEN string(id % 4) END AS p").unionByName(spark.sql("SELECT -1L AS id, 'X' AS s, '1' AS p"))
    scopes = spark.range(n).selectExpr("id AS sid", "'F' AS s", "CASE WHEN id % 2 = 0 THEN '1' END AS p", "double(least(id div 10, 3999 - id % 2)) AS v")
    got = within(spark, 60, lambda: asof.scope_match(query, scopes, ["s"], ["p"], ["v", "sid"], ["sid", "v"]).selectExpr("CASE WHEN id >= 0 THEN p END AS p", "s", "sid", "v").distinct().collect())
    odd, even = (n - 1, 3998.0), (n - 2, 3999.0)  # odd ids leave p open
    assert {(r.s, r.p): (r.sid, r.v) for r in got} == {("F", "0"): odd, ("F", "1"): even, ("F", "2"): odd, ("F", None): odd, ("X", None): (None, None)}


def test_scopes_with_several_open_columns(spark):
    query = spark.createDataFrame([(1, "a", "b"), (2, "a", None), (3, "c", "d"), (3, "c", "d")], "id int, p string, q string")
    scopes = spark.createDataFrame([(10, None, None, 1.0), (11, "a", None, 2.0), (12, "a", "b", 1.5), (13, None, "d", 1.0), (14, None, None, None)], "sid int, p string, q string, v double")
    got = asof.scope_match(query, scopes, [], ["p", "q"], ["v", "sid"], ["sid"]).collect()
    assert sorted((r.id, r.sid) for r in got) == [(1, 11), (2, 11), (3, 13)]


EVENT = "SELECT {0} AS event_id, TIMESTAMP '{1}' AS ts, {2} AS user_id, 'view' AS event_type, {3} AS value, '{{}}' AS props"


def test_events_without_value_have_a_share(spark, tmp_path):
    made = [(1, 1, "0.0::DOUBLE"), (2, 1, "3.0"), (3, 1, "NULL"), (4, 2, "0.0"), (5, 3, "-1.0"), (6, 3, "1.0"), (7, "NULL", "1.5"), (8, "NULL", "0.0")]
    assert matches(spark, tmp_path, "devig", events=" UNION ALL ".join(EVENT.format(k, "2024-01-01", user, v) for k, user, v in made))


@pytest.mark.parametrize(("event", "bout"), [("00:29:59.9", "01:00:00.8"), ("01:00:00.8", "00:29:59.9"), ("00:00:00", "00:30:00.999999"), ("00:00:00", "00:30:01"), ("23:59:59.5", "23:30:00")])
def test_parts_of_a_second_dont_count_against_the_window(spark, tmp_path, event, bout):
    """30 minutes and 0.9 seconds are 1800 whole seconds, though they reach past the next cell of 30 minutes."""
    assert matches(spark, tmp_path, "event_matching", events=EVENT.format(2, f"2024-01-01 {event}", 7, "1.0") + " UNION ALL " + EVENT.format(3, f"2024-01-01 {bout}", 7, "1.0"))
    assert matches(spark, tmp_path, "event_matching", events=EVENT.format(2, f"1969-01-01 {event}", 7, "1.0") + " UNION ALL " + EVENT.format(3, f"1969-01-01 {bout}", 7, "1.0"))


def test_nothing_of_an_item_is_worked_out_twice(spark):
    """What the plan mentions is worked out as often within a lambda; 786 mentions have become 88."""
    docs = spark.createDataFrame([(1, '{"items":[]}')], "doc int, body string")
    for made in (scoreboards.prices(docs, "doc", "body"), scoreboards.price_documents(docs, "doc", "body")):
        assert made._jdf.queryExecution().optimizedPlan().treeString(True, False, 100_000, False, False).lower().count("variant_get") < 200


@pytest.mark.parametrize(("written", "read"), [('" \\t+7\\n"', 7), ('"-0"', 0), ('"++7"', None), ('"7 7"', None), ("3000000000", None), ('"3000000000"', None), ("12.9", 12), ("-1.5e1", -15), ("true", None), ("null", None), ('""', None), ("[7]", None)])
def test_prices_as_they_are_written(spark, written, read):
    body = f'{{"items":[{{"homeOdds":{{"moneyLine":{written}}},"awayOdds":{{"moneyLine":1}}}}]}}'
    got = scoreboards.prices(spark.createDataFrame([(1, body)], "doc int, body string"), "doc", "body").where("side = 'home'").collect()
    assert [r.american for r in got] == ([] if read is None else [read])


def shuffle_files(spark) -> set[str]:
    """Names of the shuffle files that lie on this machine's disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name for f in files.split("\n") if (name := f.rsplit("/", 1)[-1]).startswith("shuffle_")}


def no_new_shuffles(spark, step) -> bool:
    """Whether a step leaves no shuffle files; they are deleted beside it, so they get some seconds."""
    before = shuffle_files(spark)
    step()
    for _ in range(50):
        if not shuffle_files(spark) - before:
            return True
        time.sleep(0.2)
    return False


def tables_aside(spark) -> set[str]:
    """Tables of `stored` that lie in the shared folder."""
    return {n for n in os.listdir(ledger.shared_dir(spark).removeprefix("file://")) if re.search(r"-[0-9a-f]{32}$", n)}


OBSERVED = "external_id string, payload_hash string, entity_kind string, subject_id string, version_kind string, detail_level string, attributes string, effective_at timestamp_ntz, observed_at timestamp_ntz, seq long"


def test_a_batch_of_grades_leaves_no_shuffles(spark, tmp_path):
    book = gradebook.GradeBook(spark, f"file://{tmp_path}/book", 4)
    calls = spark.createDataFrame([(f"c{k}", str(k % 7), "moneyline", "fighter_a", None, "confirmed_value", "x", 2.0, 1.9) for k in range(50)], grading.CALL)
    versions = spark.createDataFrame([(str(k), "current", 1, "decisive", "ko_tko", "a", 10, 3, False) for k in range(7)], grading.VERSION)
    had = tables_aside(spark)
    assert no_new_shuffles(spark, lambda: book.apply(calls, versions, datetime(2024, 1, 1)))
    assert tables_aside(spark) == had and book.grades().count() == 50


def test_a_batch_of_observations_is_staged_once(spark, tmp_path):
    store = ingest.Store(spark, f"file://{tmp_path}/store", 4)
    rows = spark.createDataFrame([(str(k), f"p{k}", "bout_result", f"s{k % 5}", "current", "verified", "", datetime(2024, 1, 1), datetime(2024, 1, 1), k) for k in range(40)], OBSERVED)
    had, aside = tables_aside(spark), []
    look = lambda step: aside.append(tables_aside(spark) - had)
    counts = []
    assert no_new_shuffles(spark, lambda: counts.append(store.apply_batch(rows, "r", "web", "s", "all", "v1", "t", look)))
    assert aside == [set(), set()] and counts == [ingest.Counts(40, 0, 0)]


def test_a_release_leaves_no_copy_of_its_pages(spark, tmp_path):
    store, had = releases.Releases(spark, f"file://{tmp_path}/site", 4), tables_aside(spark)
    rows = spark.range(200).selectExpr("id % 3 AS doc", "id")
    assert no_new_shuffles(spark, lambda: store.publish("one", rows, "doc", ["id"], ["id"], 16))
    assert tables_aside(spark) == had and store.bodies().count() == store.pages().count()
