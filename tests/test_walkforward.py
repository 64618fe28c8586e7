"""Walk-forward backtests: corrections by their time, held-out cards, no card on itself, later cards and restarts change nothing."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import walkforward
from tidemark.sources.backtests import Backtest, Backward

MODEL = walkforward.Model(("reach", "pace"))
START = datetime(2020, 1, 1)
CONTESTS = "contest string, card string, holdout boolean, reach double, pace double"
CARDS = "card string, cutoff timestamp_ntz"
VERSIONS = "contest string, rank int, seen timestamp_ntz, y int"


def day(k, hours=0):
    return START + timedelta(days=k, hours=hours)


def league(cards, per=6, seed=5):
    """Cards ten days apart, results a day later, every fifth corrected 25 days later, every seventh a draw at first."""
    rng = np.random.default_rng(seed)
    contests, versions = [], []
    for k in range(cards):
        for i in range(per):
            x, name = rng.integers(-300, 300, 2) / 100, f"{k:02d}-{i}"
            y = int(x[0] + rng.normal() > 0)
            contests.append((name, f"card{k:02d}", k == 4, float(x[0]), float(x[1])))
            versions.append((name, 1, day(10 * k + 1), None if (k * per + i) % 7 == 3 else y))
            if (k * per + i) % 5 == 2:
                versions.append((name, 2, day(10 * k + 25), 1 - y))
    return contests, [(f"card{k:02d}", day(10 * k)) for k in range(cards)], versions


def tables(spark, contests, cards, versions):
    return spark.createDataFrame(contests, CONTESTS), spark.createDataFrame(cards, CARDS), spark.createDataFrame(versions, VERSIONS)


def predicted(spark, contests, cards, versions):
    return {r.contest: r for r in walkforward.walk(*tables(spark, contests, cards, versions), MODEL).predictions.collect()}


def by_hand(contests, cards, versions):
    """Each card fitted anew, with numpy."""
    cutoffs, raws, out = dict(cards), {}, {}
    card_of = {c[0]: c for c in contests}

    def labels(cut):
        held = {}
        for name, rank, seen, y in sorted(versions, key=lambda v: (v[1], v[2])):
            own = cutoffs[card_of[name][1]]
            if seen <= cut and own < cut and not card_of[name][2]:
                held[name] = y
        return {k: y for k, y in held.items() if y is not None}

    for card, cut in sorted(cards, key=lambda c: c[1]):
        known = labels(cut)
        x = np.array([[round(v * 100) for v in card_of[k][3:]] for k in known]).reshape(-1, 2)
        t = np.array([2 * y - 1 for y in known.values()])
        own = (x * x).sum(axis=0) / max(len(x), 1)
        theta = np.linalg.solve(x.T @ x + np.diag(own), x.T @ t) if len(x) else np.zeros(2)
        for c in contests:
            if c[1] == card:
                raws[c[0]] = min(max(0.5 + theta @ [round(v * 100) for v in c[3:]] / 2, 0.01), 0.99)
        for c in contests:
            if c[1] == card:
                mine = [y for k, y in known.items() if int(raws[k] * 20) == int(raws[c[0]] * 20)]
                out[c[0]] = (len(known), raws[c[0]], (sum(mine) + 25 * raws[c[0]]) / (len(mine) + 25))
    return out


def test_every_card_equals_a_fit_made_anew(spark):
    data = league(8)
    found, want = predicted(spark, *data), by_hand(*data)
    assert set(found) == set(want)
    for k, (n, raw, p) in want.items():
        assert (found[k].n_train, found[k].status) == (n, "scored")
        assert found[k].raw == pytest.approx(raw, abs=1e-12) and found[k].p == pytest.approx(p, abs=1e-12)


def test_a_correction_counts_from_when_it_was_seen(spark):
    contests = [("old", "a", False, 1.0, 0.0), ("soon", "b", False, 1.0, 0.0), ("late", "c", False, 1.0, 0.0)]
    cards = [("a", day(0)), ("b", day(10)), ("c", day(30))]
    found = predicted(spark, contests, cards, [("old", 1, day(1), 1), ("old", 2, day(20), 0)])
    assert found["old"].raw == 0.5 and found["soon"].raw > 0.5 and found["late"].raw < 0.5
    assert found["late"].n_train == 1  # the earlier label is taken out
    assert found["late"].raw == pytest.approx(1 - found["soon"].raw)


def test_held_out_cards_train_neither_weights_nor_calibrator(spark):
    contests = [("dev", "a", False, 1.0, 1.0), ("first", "h1", True, 1.0, 1.0), ("second", "h2", True, 1.0, 1.0)]
    cards = [("a", day(0)), ("h1", day(10)), ("h2", day(20))]
    found = predicted(spark, contests, cards, [("dev", 1, day(1), 1), ("first", 1, day(11), 0), ("second", 1, day(21), 0)])
    assert found["first"].n_train == found["second"].n_train == 1
    assert (found["first"].raw, found["first"].p) == (found["second"].raw, found["second"].p)


def test_no_card_trains_on_itself(spark):
    """A result that was seen before its card's cutoff counts after that cutoff only."""
    contests = [("early", "a", False, 1.0, 0.0), ("same", "a", False, 1.0, 0.0), ("next", "b", False, 1.0, 0.0)]
    found = predicted(spark, contests, [("a", day(5)), ("b", day(6))], [("early", 1, day(0), 1), ("early", 1, day(0), 1)])
    assert (found["early"].n_train, found["same"].n_train, found["next"].n_train) == (0, 0, 1)


def test_swapped_corners_give_the_other_chance(spark):
    contests, cards, versions = league(5)
    other = [(*c[:3], -c[3], -c[4]) for c in contests], cards, [(*v[:3], None if v[3] is None else 1 - v[3]) for v in versions]
    a, b = predicted(spark, contests, cards, versions), predicted(spark, *other)
    assert all(b[k].raw == pytest.approx(1 - a[k].raw, abs=1e-12) for k in a)


def test_later_cards_change_no_earlier_digest(spark):
    contests, cards, versions = league(8)
    before = set(cards[i][0] for i in range(5))
    early = [c for c in contests if c[1] in before], cards[:5], [v for v in versions if v[0][:2] < "05"]
    digest = lambda data: {r.card: (r.n, r.digest) for r in walkforward.digests(walkforward.walk(*tables(spark, *data), MODEL).predictions).collect()}
    first, second = digest(early), digest((contests, cards, [*versions, ("00-0", 9, day(75), 0)]))
    assert len(second) == 8 and {k: second[k] for k in first} == first


def test_advances_equal_one_walk_bit_for_bit(spark, tmp_path):
    data = tables(spark, *league(8))
    test = Backtest(spark, f"file://{tmp_path}/walk", MODEL, 2)

    def stop(step):
        if step == "fits":
            raise RuntimeError("stopped")

    test.advance(*data, day(22))
    with pytest.raises(RuntimeError):
        test.advance(*data, day(47), stop)
    assert test.reached() == day(22) and test.predictions().agg({"cutoff": "max"}).first()[0] == day(20)
    test.advance(*data, day(47))
    with pytest.raises(Backward):
        test.advance(*data, day(47))
    test.advance(*data, day(100))
    whole = walkforward.walk(*data, MODEL).predictions
    digest = lambda df: sorted(tuple(r) for r in walkforward.digests(df).collect())
    assert digest(test.predictions()) == digest(whole)


def test_nulls_repeats_and_empty_tables(spark):
    nan = float("nan")
    contests = [("a", "x", None, 1.0, 1.0), ("b", "x", False, None, 1.0), ("c", "x", False, nan, 1.0), ("d", "gone", False, 1.0, 1.0), ("e", None, False, 1.0, 1.0), (None, "x", False, 1.0, 1.0)]
    versions = [("a", 1, day(1), None), ("b", 1, day(1), 1), (None, 1, day(1), 1), ("d", 1, None, 1), ("unknown", 1, day(1), 1)]
    found = walkforward.walk(*tables(spark, contests, [("x", day(0)), ("x", day(3)), ("y", None)], versions), MODEL).predictions.collect()
    assert {r.contest: (r.status, r.p) for r in found} == {"a": ("scored", 0.5), "b": ("no_features", None), "c": ("no_features", None), "d": ("no_cutoff", None), "e": ("no_cutoff", None), None: ("scored", 0.5)}
    assert walkforward.walk(*tables(spark, [], [], []), MODEL).predictions.collect() == []
