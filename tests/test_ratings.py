"""Ratings by period: frozen within a period, blind to the future, the same when continued."""

from __future__ import annotations

import math
import random

from tidemark.operators import ratings

SCHEMA = "period int, a string, b string, score double"


def brute(games):
    q = math.log(10) / 400
    g = lambda rd: 1 / math.sqrt(1 + 3 * q * q * rd * rd / math.pi**2)
    state, before = {}, {}
    for period in sorted({p for p, a, b, s in games if None not in (p, a, b, s) and a != b}):
        met = {}
        for p, a, b, s in games:
            if p == period and None not in (a, b, s) and a != b:
                met.setdefault(a, []).append((b, s))
                met.setdefault(b, []).append((a, 1 - s))
        new = {}
        for x, games_of in met.items():
            r, d, n, w = before[period, x] = state.get(x, (1500.0, 350.0, 0, 0))
            inverse = step = 0.0
            for y, s in games_of:
                ro, do, *_ = state.get(y, (1500.0, 350.0, 0, 0))
                e = 1 / (1 + 10 ** (-g(do) * (r - ro) / 400))
                inverse += q * q * g(do) ** 2 * e * (1 - e)
                step += g(do) * (s - e)
            rd = max(50.0, math.sqrt(1 / (1 / d**2 + inverse)))
            new[x] = (r + q * rd * rd * step, rd, n + len(games_of), w + sum(s != 0.5 for _, s in games_of))
        state |= new
    return before, state


def collected(before, state):
    b = {(r.period, r.player): tuple(r)[2:] for r in before.collect()}
    return b, {r.player: tuple(r)[1:] for r in state.select("player", *ratings.KEPT).collect()}


def same(x, y):
    assert x.keys() == y.keys() and all(math.isclose(p, q, rel_tol=1e-12, abs_tol=1e-9) for k in x for p, q in zip(x[k], y[k], strict=True))


def made():
    rng = random.Random(8)
    games = [(p, rng.choice("abcdefg"), rng.choice("abcdefgh"), rng.choice([0.0, 0.5, 1.0])) for p in (3, 1, 2, 7) for _ in range(12)]
    return games + [(1, "hot", x, 1.0) for x in "abcdefgh" * 4] + [(None, "a", "b", 1.0), (2, None, "b", 1.0), (2, "a", "b", None), games[0]]


def test_ratings_by_hand(spark):
    games = made()
    before, state = brute(games)
    got_before, got_state = collected(*ratings.rate(spark.createDataFrame(games, SCHEMA)))
    same(got_before, before)
    same(got_state, state)


def test_a_period_is_rated_at_once(spark):
    before, state = collected(*ratings.rate(spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "c", 1.0)], SCHEMA)))
    assert set(before.values()) == {(1500.0, 350.0, 0, 0)}
    assert state["a"][0] > 1500 > state["c"][0] and math.isclose(state["b"][0], 1500, abs_tol=1e-9)


def test_later_games_change_nothing_before(spark):
    games = made()
    early = [g for g in games if g[0] is not None and g[0] <= 2]
    whole, _ = collected(*ratings.rate(spark.createDataFrame(games, SCHEMA)))
    part, _ = collected(*ratings.rate(spark.createDataFrame(early, SCHEMA)))
    assert part == {k: v for k, v in whole.items() if k[0] <= 2}


def test_a_run_can_be_continued(spark):
    games = [g for g in made() if g[0] is not None]
    _, whole = collected(*ratings.rate(spark.createDataFrame(games, SCHEMA)))
    _, held = ratings.rate(spark.createDataFrame([g for g in games if g[0] <= 2], SCHEMA))
    _, on = collected(*ratings.rate(spark.createDataFrame([g for g in games if g[0] > 2], SCHEMA), held))
    same(on, whole)


def test_no_games(spark):
    before, state = ratings.rate(spark.createDataFrame([], SCHEMA))
    assert before.count() == 0 and state.count() == 0
