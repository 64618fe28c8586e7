"""Leakage audits: an honest table holds, a leak of one cell is found by column and key, and an audit that sees nothing fails."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import leakage
from tidemark.operators.leakage import ROWS, Mutation

FACTS = "who int, card string, seen int, value double"
CUT = 100


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([(k % 40, f"c{k % 7}", k % 90, float(k % 11)) for k in range(400)], FACTS)


def honest(df):
    known = df.where(F.col("seen") <= CUT)
    return known.groupBy("who").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def leaky(df):
    """The total takes what was seen later too."""
    return df.groupBy("who").agg(F.count_if(F.col("seen") <= CUT).alias("n"), F.sum("value").alias("total"))


def later(df):
    return df.unionByName(df.sparkSession.createDataFrame([(7, "c0", CUT + 1, 5.0)], FACTS))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_future_rows_leave_an_honest_table_as_it_is(spark, facts):
    known = Mutation(lambda df: df.unionByName(df.sparkSession.createDataFrame([(7, "c0", CUT, 5.0)], FACTS)), same=False)
    out = {r.check: r for r in leakage.audit(honest, facts, {"future": Mutation(later), "shuffled": Mutation(lambda df: df.repartition(5)), "seen": known, "vacuous": Mutation(later, same=False)}, ["who"], 64).collect()}
    assert {k: r.passed for k, r in out.items()} == {"future": True, "shuffled": True, "seen": True, "vacuous": False}
    assert out["future"].first_column is None and out["seen"].n_columns == 2 and out["seen"].n_blocks == 1


def test_a_leak_of_one_row_is_located(facts):
    before, after = leaky(facts), leaky(later(facts))
    found = leakage.differing(before, after, ["who"], 64).collect()
    assert [r.column for r in found] == ["total"]
    (cell,) = leakage.changed_cells(before, after, ["who"], 64).collect()
    assert (cell.who, cell.column, float(cell.after) - float(cell.before)) == (7, "total", 5.0)
    failed = leakage.audit(leaky, facts, {"future": Mutation(later)}, ["who"], 64).first()
    assert (failed.passed, failed.n_columns, failed.n_blocks, failed.first_column, failed.first_block) == (False, 1, 1, "total", found[0].block)


def test_a_card_excluded_changes_its_own_rows_alone(facts):
    by_card = lambda df: df.groupBy("card").agg(F.count("*").alias("n"))
    gone = lambda df: df.where("card <> 'c3'")
    out = leakage.audit(by_card, facts, {"others": Mutation(gone, scope=F.col("card") != "c3"), "own": Mutation(gone, same=False, scope=F.col("card") == "c3")}, ["card"])
    assert [r.passed for r in out.collect()] == [True, True]
    assert rows(leakage.changed_cells(by_card(facts), by_card(gone(facts)), ["card"]).where(F.col("column") == ROWS)) == [("c3", ROWS, "1", "0")]


@pytest.mark.parametrize("a, b, want", [
    ([(1, 1.0), (2, 2.0)], [(1, 2.0), (2, 1.0)], [(1, "v", "1.0", "2.0"), (2, "v", "2.0", "1.0")]),  # values change places
    ([(1, 1.0), (1, 1.0)], [(1, 2.0), (1, 2.0)], [(1, "v", "1.0,1.0", "2.0,2.0")]),  # pairs cancel in the exclusive or
    ([(1, None)], [(1, 0.0)], [(1, "v", "null", "0.0")]),
    ([(1, 1.0)], [(1, 1.0), (1, 1.0)], [(1, ROWS, "1", "2"), (1, "v", "1.0", "1.0,1.0")]),
    ([(None, 1.0)], [], [(None, ROWS, "1", "0"), (None, "v", "1.0", "")]),
    ([(1, float("nan"))], [(1, float("nan"))], []),
    ([], [], []),
])
def test_cells_that_differ(spark, a, b, want):
    make = lambda r: spark.createDataFrame(r, "k int, v double")
    assert rows(leakage.changed_cells(make(a), make(b), ["k"], 8)) == sorted(want, key=str)
    assert bool(leakage.differing(make(a), make(b), ["k"], 8).count()) == bool(want)
