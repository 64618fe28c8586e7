"""The ladder's rules one by one, reviews with reversals, and identities under constraints against brute force."""

from __future__ import annotations

import random
from datetime import date

import pytest

from tidemark.operators import identity

BORN = date(1990, 1, 2)
PEOPLE = [(1, "dob one", BORN), (2, "dob one", date(1991, 1, 1)), (3, "context alpha", None), (4, "shared opponent", None), (5, "shared name", BORN), (6, "shared name", BORN), (7, "wiki first", None), (8, "plain", None), (9, "other wiki", None), (10, "context alpha", None)]
LINKS = [("web", "dup", 8), ("wikidata", "Q7", 7), ("wikidata", "Q8", 8), ("wikidata", "Q8", 9), ("web", "prio", 6)]
BOUTS = [("e1", date(2020, 1, 1), 3, 4), ("e2", date(2021, 1, 1), 3, 4), ("e2", date(2021, 1, 1), 10, 4), ("e3", None, 3, None), ("e3", None, 3, 3)]
COMING = "source string, external_id string, name string, wikidata_id string, born date, opponent string, event_id string, event_date date, hinted boolean"
# name, wikidata_id, born, opponent, event_id, event_date, hinted -> kind, reason, person
CASES = {
    "dup": (("someone else",), ("queued", "duplicate_external_id", None)),
    "prio": (("shared name", None, BORN), ("linked", "exact_source_external_id", 6)),
    "a": (("wiki first ascii", "Q7", None, None, None, None, True), ("linked", "exact_wikidata", 7)),
    "b": (("x", "Q8"), ("queued", "wikidata_conflict", None)),
    "c": (("dob one", "Q7", BORN), ("queued", "wikidata_conflicts_with_name_dob", None)),
    "d": (("jonny", None, None, None, None, None, True), ("queued", "candidate_hints_forbid_auto_link", None)),
    "e": (("dob one", None, BORN), ("linked", "name_dob", 1)),
    "f": (("shared name", None, BORN), ("queued", "name_dob_not_unique", None)),
    "g": (("dob one", None, date(1999, 1, 1)), ("queued", "dob_conflict", None)),
    "h": (("dob one",), ("queued", "same_normalized_name_without_unique_key", None)),
    "i": (("context alpha", None, None, "shared opponent", "e1", date(2020, 1, 1)), ("linked", "name_context", 3)),
    "j": (("context alpha", None, None, "shared opponent", "e1"), ("linked", "name_context", 3)),
    "k": (("context alpha", None, None, "shared opponent", None, date(2021, 1, 1)), ("queued", "context_not_unique", None)),
    "l": (("context alpha", None, None, "shared opponent"), ("queued", "same_normalized_name_without_unique_key", None)),
    "m": (("context alpha", None, None, "shared opponent", "e1", date(2021, 1, 1)), ("queued", "same_normalized_name_without_unique_key", None)),
    "n": (("nobody", "Q999", BORN, "x", "e9"), ("created", "no_existing_person", None)),
    "o": (("plain", None, BORN), ("queued", "same_normalized_name_without_unique_key", None)),
}


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(PEOPLE, "person long, name string, born date"), spark.createDataFrame(LINKS, "source string, external_id string, person long"), spark.createDataFrame(BOUTS, "event_id string, event_date date, a long, b long")


def coming(spark, cases):
    return spark.createDataFrame([("web", k, *x, *[None] * (7 - len(x))) for k, (x, _) in cases.items()], COMING)


def test_ladder(spark, tables):
    rows = coming(spark, CASES).unionByName(spark.createDataFrame([("web", " ", "x", *[None] * 6), ("web", "z", None, *[None] * 6)], COMING))
    got = identity.resolve(rows, *tables)
    assert {r.external_id: (r.kind, r.reason, r.person) for r in got.collect()} == {k: want for k, (_, want) in CASES.items()}
    assert {r.rule for r in got.where("kind = 'created'").collect()} == {identity.CREATE}
    held = identity.resolve(coming(spark, {"n": CASES["n"]}), *tables, create=False).first()
    assert (held.kind, held.reason) == ("queued", "create_disabled")
    assert {(r.external_id, r.person) for r in identity.candidates(rows, tables[0], got).where("external_id IN ('f', 'h')").collect()} == {("f", 5), ("f", 6), ("h", 1), ("h", 2)}
    assert identity.resolve(rows.limit(0), *tables).count() == 0
    assert {r.kind for r in identity.resolve(rows, *(t.limit(0) for t in tables)).where("external_id NOT IN ('a', 'd')").collect()} == {"created"}


def test_reviews_take_what_their_state_allows(spark):
    said = {1: ["approve", "approve", "reject", "reverse", "approve"], 2: ["reverse", "reject", "reject", "reverse"], 3: ["approve"]}
    df = spark.createDataFrame([(k, v + 1, d) for k, ds in said.items() for v, d in enumerate(ds)], "review long, version long, decision string")
    got = {(r.review, r.version): (r.state, r.accepted) for r in identity.transitions(df).collect()}
    assert [got[1, v] for v in range(1, 6)] == [("approved", True), ("approved", True), ("approved", False), ("reversed", True), ("reversed", False)]
    assert [got[2, v] for v in range(1, 5)] == [("pending", False), ("rejected", True), ("rejected", True), ("reversed", True)]
    assert {r.review: r.state for r in identity.in_force(df).collect()} == {1: "reversed", 2: "reversed", 3: "approved"}


def brute(records, keys, must, cannot):
    parent = {r: r for r, _ in records}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        if a in parent and b in parent:
            x, y = sorted((top(a), top(b)))
            parent[y] = x

    by_key = {}
    for r, k in keys:
        if k is not None and r in parent:
            join(by_key.setdefault(k, r), r)
    for a, b in must:
        join(a, b)
    groups, born = {}, dict(records)
    for r in parent:
        groups.setdefault(top(r), []).append(r)
    out = {}
    for g, members in groups.items():
        torn = any(a != b and a in members and b in members for a, b in cannot)
        aged = len({born[m] for m in members if born[m] is not None}) > 1
        state = "single" if len(members) == 1 else "conflict" if torn or aged else "merged"
        for m in members:
            out[m] = (g, state, g if state == "merged" else m, ("must_not_be_one" if torn else "dob_conflict") if state == "conflict" else None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_identities_by_hand(spark, seed):
    rng = random.Random(seed)
    records = [(k, rng.choice([None, None, None, 1, 2])) for k in range(60)]
    keys = [(rng.randrange(65), rng.choice([None, *(f"k{j}" for j in range(40))])) for _ in range(60)]
    must = [(rng.randrange(62), rng.randrange(62)) for _ in range(10)] + [(k, k + 1) for k in range(40, 55)]
    cannot = [(rng.randrange(62), rng.randrange(62)) for _ in range(6)] + [(3, 3)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = identity.identities(make(records, "record long, born int"), make(keys, "record long, key string"), make(must, "a long, b long"), make(cannot, "a long, b long"))
    assert {r.record: (r.component, r.state, r.identity, r.reason) for r in got.collect()} == brute(records, keys, must, cannot)


def test_a_reversed_review_splits_again(spark):
    records = spark.createDataFrame([(1, None), (2, None), (3, None)], "record long, born int")
    none = spark.createDataFrame([], "record long, key string")
    said = [(9, 1, "approve"), (8, 1, "approve")]
    pair = spark.createDataFrame([(9, 1, 2), (8, 2, 3)], "review long, a long, b long")

    def ids(reviews):
        force = identity.in_force(spark.createDataFrame(reviews, "review long, version long, decision string")).join(pair, "review")
        return {r.record: r.identity for r in identity.identities(records, none, force.where("state = 'approved'").select("a", "b"), force.where("state = 'rejected'").select("a", "b")).collect()}

    assert ids(said) == {1: 1, 2: 1, 3: 1}
    assert ids([*said, (8, 2, "reverse")]) == {1: 1, 2: 1, 3: 3}
