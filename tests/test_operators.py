"""Properties that SQL on the driver's tables doesn't show: traps, ties, late facts, folds."""

from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import odds, outcomes, text
from tidemark.operators import asof, ledger, markets, models, paths, policy, quotes, ratings, resample, schedule, scores
from tidemark.sources import pages, payloads


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def ts(s):
    return F.lit(s).cast("timestamp_ntz")


@pytest.mark.parametrize(("effective", "observed", "seen"), [("2024-01-01", "2024-01-02", True), ("2024-01-02", "2024-01-02", False), ("2024-01-01", "2024-01-02 00:00:01", False)])
def test_effective_is_strict_and_observed_inclusive(spark, effective, observed, seen):
    assert one(spark, asof.visible(ts(effective), ts(observed), ts("2024-01-02"))) is seen


def test_future_facts_change_nothing(spark):
    schema = "k int, id int, v int, effective_at timestamp_ntz, observed_at timestamp_ntz"
    t = datetime.fromisoformat
    base = spark.createDataFrame([(1, 1, 10, t("2024-01-01"), t("2024-01-01")), (1, 2, 20, t("2024-01-01"), t("2024-01-01")), (2, 3, 30, t("2024-01-03"), t("2024-01-03"))], schema)
    late = spark.createDataFrame([(1, 4, 99, t("2024-01-01"), t("2024-02-01")), (2, 5, 99, t("2024-02-01"), t("2024-01-01"))], schema)
    ask = lambda df: sorted(map(tuple, asof.latest_as_of(df, ["k"], ["effective_at", "observed_at", "id"], ts("2024-01-10")).select("k", "v").collect()))
    assert ask(base) == ask(base.unionByName(late)) == [(1, 20), (2, 30)]


def test_proxy_cutoffs_take_nothing_off(spark):
    c = asof.cutoff_of(F.lit(None).cast("timestamp_ntz"), F.lit("2024-05-05").cast("date"), allow_proxy=True)
    assert str(one(spark, c["cutoff"])) == "2024-05-05 00:00:00"
    c = asof.cutoff_of(ts("2024-05-05 20:00:00"), F.lit("2024-05-05").cast("date"))
    assert str(one(spark, c["cutoff"])) == "2024-05-05 19:00:00"


def test_unknown_at_the_same_time_blocks(spark):
    assert one(spark, quotes.unknown_blocks(ts("2024-01-01"), ts("2024-01-01"))) is True
    assert one(spark, quotes.unknown_blocks(ts("2024-01-01"), ts("2024-01-01 00:00:01"))) is False


def test_staleness_is_strict(spark):
    assert one(spark, quotes.is_stale(ts("2024-01-01 00:00:00"), ts("2024-01-01 06:00:00"))) is False
    assert one(spark, quotes.is_stale(ts("2024-01-01 00:00:00"), ts("2024-01-01 06:00:01"))) is True


def test_bins_use_the_exact_edges(spark):
    got = [one(spark, scores.bin_of(F.lit(p))) for p in (0.3, 0.30000000000000004, 0.6, 0.7, 1.0, 0.0)]
    edges = np.linspace(0, 1, 11)
    assert got == [min(int(np.searchsorted(edges, p, side="right")) - 1, 9) for p in (0.3, 0.30000000000000004, 0.6, 0.7, 1.0, 0.0)]


def test_invalid_odds_are_null(spark):
    for bad in (50.0, -99.0, float("nan")):
        assert one(spark, odds.american_to_decimal(F.lit(bad))) is None
    assert one(spark, odds.american_to_decimal(F.lit(-200.0))) == 1.5
    assert one(spark, odds.decimal_to_american(F.lit(1.5))) == -200
    assert one(spark, odds.price_targets(F.lit(0.4), F.lit(0.5), F.lit("moneyline"))) is None


def test_a_null_field_changes_the_key(spark):
    key = lambda *v: one(spark, text.identity_key([F.lit(x).cast("string") for x in v]))
    assert len({key("a", None, "b"), key("a", "b", None), key("a", "", "b"), key(None, "a", "b")}) == 4


def test_names_keep_accents(spark):
    assert one(spark, text.nfkc_name(F.lit("  Ｊosé   STRAẞE "))) == "josé strasse"


@pytest.mark.parametrize(("rd", "clock", "rounds", "reason", "seconds"), [(1, "5:00", 3, None, 300), (2, "0:00", 3, None, 300), (4, "1:00", 3, "ending_round_exceeds_scheduled_rounds", None), (1, "5:01", 3, "time_exceeds_round_length", None), (1, "x", 3, "malformed_time_str", None), (None, " ", 3, "ending_round_and_time_missing", None), (1, None, 3, "ending_round_or_time_incomplete", None), (0, "1:00", 3, "ending_round_out_of_range", None), (1, "1:00", 0, "scheduled_rounds_must_be_positive", None)])
def test_durations(spark, rd, clock, rounds, reason, seconds):
    got = one(spark, outcomes.elapsed_seconds(F.lit(rd).cast("int"), F.lit(clock).cast("string"), F.lit(rounds)))
    assert (got.reason, got.seconds) == (reason, seconds)


def test_half_rounds_are_closed_on_the_right(spark):
    assert [one(spark, outcomes.half_round(F.lit(e), F.lit(3))) for e in (0, 1, 150, 151, 300, 900)] == [0, 0, 0, 1, 1, 5]


def test_ambiguous_prices_are_refused(spark):
    schema = "k int, quote_id long, observed_at timestamp_ntz, price double, availability string, lifecycle string, eligible boolean, replacement boolean, ambiguous boolean"
    t = datetime(2024, 1, 1)
    q = spark.createDataFrame([(None, 1, t, 2.0, "available", "active", True, False, False), (1, 2, t, 2.0, "available", "active", True, False, False), (1, 3, t, 2.1, "available", "active", True, False, False)], schema)
    wanted = spark.createDataFrame([(None,), (1,), (2,)], "k int")
    got = {r.k: (r.reason, r.price) for r in quotes.join_quotes(wanted, q, ["k"], ts("2024-01-02")).collect()}
    assert got == {None: (None, 2.0), 1: ("ambiguous_odds", None), 2: ("threshold_only", None)}


def test_ledger_appends_once(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    first = ledger.to_append(old, new, ["k"], ["v"])
    assert [tuple(r) for r in first.collect()] == [(2, "b")]
    assert ledger.to_append(old.unionByName(first), new, ["k"], ["v"]).isEmpty()
    assert [r.k for r in ledger.contradictions(old, spark.createDataFrame([(1, "z")], "k int, v string"), ["k"], ["v"]).collect()] == [1]


def test_a_gate_that_cannot_be_told_fails(spark):
    reasons = policy.gate_reasons([("a", F.lit(None).cast("boolean")), ("b", F.lit(True)), ("c", F.lit(False))])
    assert one(spark, reasons) == ["a", "c"]
    assert one(spark, policy.primary(reasons, ("c", "a"))) == "c"
    assert one(spark, policy.primary(F.array().cast("array<string>"), ("c", "a"))) is None


def test_cadence_is_half_open(spark):
    names = [one(spark, schedule.cadence(F.lit(s))["window"]) for s in (259201, 259200, 86401, 86400, 21600, 3600, 1, 0)]
    assert names == [None, "far", "far", "mid", "near", "final", "final", None]


def test_platt_and_temperature_recover_a_distortion():
    rng = np.random.default_rng(1)
    logit = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * logit + 0.3)))).astype(float)
    a, b = models.platt(logit, y)
    assert abs(a - 0.5) < 0.06 and abs(b - 0.3) < 0.1
    z = rng.normal(0, 1, (3000, 3))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    c = (rng.random(3000)[:, None] > p.cumsum(axis=1)).sum(axis=1)
    assert abs(models.temperature(z * 3, c) - 3) < 0.4


def test_ridge_is_swap_safe(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-x @ [1.0, -1.0, 0.0]))).astype(int)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(y=y, fold=0))
    fit = models.fit_ridge_by(df, "fold", list("abc"), "y").first()
    assert fit.weights[0] > 0.5 and fit.weights[1] < -0.5 and abs(fit.weights[2]) < 0.4
    w = F.array(*map(F.lit, fit.weights))
    p = models.win_probability(w, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    q = models.win_probability(w, F.array(F.lit(-1.0), F.lit(-2.0), F.lit(-3.0)))
    assert math.isclose(one(spark, p) + one(spark, q), 1)


def test_hazard_gradient():
    rng = np.random.default_rng(3)
    x, c = rng.normal(0, 1, (40, 4)), rng.integers(0, 3, 40)
    theta = rng.normal(0, 0.3, (4, 3))
    loss, grad = models.softmax_loss(theta, x, c, 1.0)
    for i, j in ((0, 0), (3, 2), (1, 1)):
        d = np.zeros_like(theta)
        d[i, j] = 1e-6
        assert math.isclose((models.softmax_loss(theta + d, x, c, 1.0)[0] - models.softmax_loss(theta - d, x, c, 1.0)[0]) / 2e-6, grad[i, j], rel_tol=1e-4, abs_tol=1e-6)
    best = models.fit_softmax(x, c, 3)
    assert models.softmax_loss(best, x, c, 1.0)[0] < loss


PAYLOAD = """{"id": "e1", "home_team": "A", "away_team": "B", "commence_time": "2024-01-01T00:00:00Z", "bookmakers": [
 {"key": "BookOne", "last_update": "2024-01-01T00:00:00Z", "markets": [{"key": "h2h", "outcomes": [{"name": "A", "price": 1.5}, {"name": "B", "price": 2.5}]}]},
 {"key": "consensus", "markets": [{"key": "h2h", "outcomes": [{"name": "A", "price": 1.4}]}]}]}"""


def test_payloads_flatten_and_tell_what_is_absent(spark):
    df = spark.createDataFrame([(PAYLOAD,), ("not json",)], "body string")
    got = payloads.quotes_of(df, "body")
    assert sorted((r.bookmaker_key, r.outcome_key, r.price) for r in got.collect()) == [("bookone", "fighter_a", 1.5), ("bookone", "fighter_b", 2.5)]
    unknown = payloads.unknown_of(df, "body", ["h2h", "totals"])
    assert [(r.bookmaker_key, r.market) for r in unknown.collect()] == [("bookone", "totals")]
    assert payloads.malformed(df, "body").count() == 1


def test_html_tables_and_links(spark):
    html = "<table><tr><th>x</th></tr><tr><td> a <b>b</b></td><td>3 of 7</td></tr></table><a href='/e/abc'>Card</a><p>unclosed"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<tr><td>")], "page_id long, html string")
    assert [tuple(r) for r in pages.cells(df, "page_id", "html").orderBy("page_id", "row", "col").collect()] == [(1, 0, 0, "x"), (1, 1, 0, "a b"), (1, 1, 1, "3 of 7")]
    assert [tuple(r) for r in pages.links(df, "page_id", "html").collect()] == [(1, "/e/abc", "abc", "Card")]


def test_folds_count_the_other_cards_before_the_cutoff(spark):
    """Ties of a start and a cutoff don't count; a card that starts before its own cutoff doesn't train itself."""
    cards = spark.createDataFrame([(1, 10, 5), (2, 20, 10), (3, 30, 35), (4, 30, 31), (5, None, 100), (6, 7, None)], "card int, start int, cut int")
    rows = cards.collect()
    want = {t.card: sorted(r.start for r in rows if r.card != t.card and r.start is not None and t.cut is not None and r.start < t.cut) for t in rows}
    got = {r.test_card: (r.n_train, r.last_train) for r in resample.expanding_folds(cards, "card", "start", "cut").collect()}
    assert got == {c: (len(s), max(s, default=None)) for c, s in want.items()}


def test_bankroll_that_loses_all_stays_at_nothing(spark):
    bets = spark.createDataFrame([(1, c, r) for c, r in enumerate([0.5, -0.2, -1.0, 0.5])] + [(2, c, r) for c, r in enumerate([0.5, -0.5, 0.2])], "k int, card int, r double")
    got = {x.k: (round(x.bankroll, 9), round(x.max_drawdown, 9)) for x in paths.kelly_bankroll(bets, ["k"], "card", "card", F.lit(1.0), F.col("r")).collect()}
    assert got == {1: (0.0, 1.0), 2: (0.9, 0.5)}


def test_rows_derive_what_atoms_derive(spark):
    p = [(k + 1) / 780 for k in range(39)]
    fine = spark.createDataFrame([(1, s, c, k, x) for (s, c, k), x in zip(markets.atom_list(3), p, strict=True)], "b int, side string, cause string, interval int, p double")
    row = spark.createDataFrame([(1, p)], "b int, p array<double>")
    a, b = ({(r.family, r.outcome): round(r.probability, 12) for r in df.collect()} for df in (markets.derive(fine, ["b"]), markets.derive_row(row, ["b"], F.col("p"), 3)))
    assert a == b and len(a) == 27


def test_a_fingerprint_sums_past_a_long(spark):
    """The sum of 48-bit hashes of 100,000 rows is over 2 ** 63."""
    import hashlib

    got = ledger.fingerprint(spark.range(100_000).select("id"), ["id"]).first()
    h = [int(hashlib.md5(str(k).encode()).hexdigest()[:12], 16) for k in range(100_000)]
    assert (got.n, int(got.s)) == (100_000, sum(h)) and sum(h) > 2**63
    assert ledger.fingerprint(spark.range(0).select("id"), ["id"]).first().s is None
