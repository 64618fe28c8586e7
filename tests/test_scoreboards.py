"""Scoreboards and price documents: what is scheduled and priced, what is passed over, and what is set aside with its reason."""

from __future__ import annotations

import json
from datetime import datetime

from tidemark.sources import scoreboards


def fight(number="1", status=None, sides=None, **more):
    sides = sides or [{"order": 2, "id": "b", "athlete": {"id": "11", "displayName": "Bo"}}, {"order": 1, "id": "a", "athlete": {"id": "10", "fullName": " Al "}}]
    return {"id": number, "competitors": sides, **({"status": status} if status else {}), **more}


def event(*fights, name="Dana White's Contender Series 70", **more):
    return {"id": "600", "name": name, "date": "2024-08-13T00:00Z", "competitions": list(fights), **more}


def docs(spark, *bodies):
    return spark.createDataFrame([(k, b if b is None or isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], "doc int, body string")


def test_scheduled_cards_with_their_corners_and_place(spark):
    first = fight(type={"abbreviation": "LW"}, date="2024-08-13", venue={"fullName": "Apex", "address": {"city": "Las Vegas", "country": "USA"}})
    body = {"events": [event(first, fight("2", {"type": {"name": "status_canceled_late"}}), "odd"), event(fight(), name="Fight Night"), event(fight(), status={"type": {"completed": True}}), event(fight(), name="DWCS Brazil", date="soon")]}
    got = [tuple(r) for r in scoreboards.scheduled_fights(docs(spark, body), "doc", "body").collect()]
    assert got == [(0, "600", "Dana White's Contender Series 70", datetime(2024, 8, 13), "Apex, Las Vegas, USA", "dwcs", "1", "10", "Al", "11", "Bo", "LW", datetime(2024, 8, 13))]


def test_incomplete_pairs_are_passed_over(spark):
    one = {"order": 1, "athlete": {"id": "1", "displayName": "A"}}
    pairs = [[one], [one, one], [one, {"order": 2, "id": "2"}], [one, {"order": 2, "athlete": {"displayName": "B"}}], [one, {"athlete": {"id": "2", "shortName": "B"}}]]
    got = scoreboards.scheduled_fights(docs(spark, {"events": [event(*[fight(str(k), sides=p) for k, p in enumerate(pairs)])]}), "doc", "body").collect()
    assert [(r.competition_id, r.a_id, r.b_id, r.weight_class, r.fight_start) for r in got] == [("4", "2", "1", None, None)]


def test_every_odd_document_is_set_aside_with_its_reason(spark):
    ok = {"events": [event(fight())]}
    bodies = [None, "{", {}, [1], {"events": {}}, {"events": None}, {"events": [5]}, {"events": [event(status="over")]}, {"events": [event(status="over", name="Fight Night")]}, {"events": [{**event(), "competitions": 3}]},
              {"events": [event(fight(status={"type": 1}))]}, {"events": [event(fight(sides={"a": 1}))]}, {"events": [event(fight(sides=[1, 2]))]}, {"events": [event(fight(sides=[{"order": "x"}, {}]))]}, ok, {"events": []}]
    want = ["not_json", "not_json", "no_events", "no_events", "events_not_array", "events_not_array", "event_not_object", "status_not_object", None, "competitions_not_array", "status_not_object", "competitors_not_array", "competitor_not_object", "order_not_number", None, None]
    data = docs(spark, *bodies)
    assert {r.doc: r.reason for r in scoreboards.scoreboard_quarantine(data, "doc", "body").collect()} == {k: w for k, w in enumerate(want) if w}
    assert [r.doc for r in scoreboards.scheduled_fights(data, "doc", "body").collect()] == [14]


def item(home, away, provider=None, names=("homeTeamOdds", "awayTeamOdds")):
    return {"provider": provider, names[0]: home, names[1]: away}


def test_prices_by_side_and_documents_by_state(spark):
    good = item({"moneyLine": -150, "athlete": {"id": 10}}, {"current": {"moneyline": "+130"}, "athleteId": "11"}, {"id": " DK ", "name": "Draft"})
    cut = item({"money_line": 120.9}, {"moneyLine": "", "moneyline": -140}, names=("homeOdds", "awayOdds"))
    bet = item({"moneyLine": 100}, {"moneyLine": 100}, {"id": "9", "name": "Bet365"})
    half = item({"moneyLine": "120.5"}, {"moneyLine": 100}, {"id": "x"})
    data = docs(spark, {"items": [good, cut, bet, half]}, {"items": []}, {"items": [bet, half]}, {"items": {}}, {"items": [None]}, {}, None)
    got = {(r.doc, r.bookmaker_key, r.side): (r.title, r.athlete_id, r.american) for r in scoreboards.prices(data, "doc", "body").collect()}
    assert got == {(0, "dk", "home"): ("Draft", "10", -150), (0, "dk", "away"): ("Draft", "11", 130), (0, "espn", "home"): ("espn", None, 120), (0, "espn", "away"): ("espn", None, -140)}
    states = [tuple(r)[1:] for r in scoreboards.price_documents(data, "doc", "body").orderBy("doc").collect()]
    assert states == [("quoted", 2, 1), ("unknown", 0, 0), ("unknown", 0, 1), ("items_not_array", 0, 0), ("item_not_object", 0, 0), ("no_items", 0, 0), ("not_json", 0, 0)]
    assert scoreboards.prices(docs(spark, {}).limit(0), "doc", "body").count() == 0
