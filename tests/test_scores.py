"""Breakdowns that must add up, and losses of terminal outcomes with every row at fault counted."""

from __future__ import annotations

from math import log

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scores


def test_dimensions_add_up_or_not(spark):
    rows = spark.createDataFrame([(["a"], 1), (["b"], 2), ([], 4), (["a", "b"], None), (None, 1)], "u array<string>, m int")
    out = scores.reconciliation(rows, {"u": F.col("u"), "all": F.array(F.lit(1))}, {"n": F.lit(1), "m": F.col("m")})
    assert {(r.dimension, r.measure): (r.total, r.slices, r.ok) for r in out.collect()} == {("u", "n"): (5, 4, False), ("u", "m"): (8, 3, False), ("all", "n"): (5, 5, True), ("all", "m"): (8, 8, True)}
    assert [r.ok for r in scores.reconciliation(rows.limit(0), {"u": F.col("u")}, {"n": F.lit(1)}).collect()] == [True]


def test_terminal_losses_and_rows_at_fault(spark):
    ask = lambda *rows: tuple(scores.terminal_log_loss(spark.createDataFrame(rows, "c map<string,double>, o string"), "c", "o").first())
    good = ({"a": 0.25, "b": 0.75}, "a")
    assert ask(good, ({"a": 1.0, "b": 0.0}, "a")) == (2, 0, 0, 0, pytest.approx(log(4) / 2))
    assert ask(good, ({"a": 0.5}, "a"), ({"a": 1.0}, "z"), ({"a": 1.0, "b": 0.0}, "b")) == (4, 1, 1, 1, None)
    assert ask(({"a": None, "b": 1.0}, "b"), ({"a": float("nan")}, "a"), (None, "a"), ({"a": 1.0}, None)) == (4, 3, 2, 1, None)
    assert scores.terminal_log_loss(spark.createDataFrame([], "c map<string,double>, o string"), "c", "o").first().nll is None
