"""Releases: the same bytes whatever the partitions, only changed pages are written, and a refused or stopped one leaves the last in place."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import releases
from tidemark.sources.releases import Refused, Releases

ROWS = "doc string, id int, b struct<z:int,a:string>, a double"


def rows(spark, n=60, change=None, parts=2):
    data = [("big" if k % 3 else f"d{k % 4}", k, (k, "x" if k != change else "y"), None if k % 5 == 0 else k / 4) for k in range(n)]
    return spark.createDataFrame(data, ROWS).repartition(parts)


def made(df, size=10):
    return {(r.doc, r.page): r for r in releases.pages_of(df, "doc", ["id"], ["b", "a", "id"], size).collect()}


def test_pages_are_canonical_whole_and_the_same_for_any_partitions(spark):
    one = made(rows(spark))
    assert {k: v.body for k, v in one.items()} == {k: v.body for k, v in made(rows(spark, parts=7)).items()}
    seen = []
    for (doc, page), r in one.items():
        body = json.loads(r.body)
        assert r.body == json.dumps(body, sort_keys=True, separators=(",", ":")) and r.digest == hashlib.sha256(r.body.encode()).hexdigest()
        assert (body["doc"], body["page"], len(body["items"])) == (doc, page, r.n)
        assert all(hashlib.sha256(str(i["id"]).encode()).hexdigest().startswith(page) for i in body["items"])
        assert [i["id"] for i in body["items"]] == sorted(i["id"] for i in body["items"])
        seen += [i["id"] for i in body["items"]]
    assert sorted(seen) == list(range(60)) and {len(p) for d, p in one if d == "big"} == {1} and ("d0", "") in one


def test_a_documents_digest_is_that_of_its_tree(spark):
    one = made(rows(spark), 2)
    want = {}
    for doc in {d for d, _ in one}:
        level = {p: r.digest for (d, p), r in one.items() if d == doc}
        while max(map(len, level)):
            up = {}
            for p in sorted(level):
                up[p[:-1]] = up.get(p[:-1], "") + level[p]
            level = {p: hashlib.sha256(x.encode()).hexdigest() for p, x in up.items()}
        want[doc] = level[""]
    pages = releases.pages_of(rows(spark), "doc", ["id"], ["b", "a", "id"], 2)
    got = releases.document_digests(pages)
    assert {r.doc: r.digest for r in got.collect()} == want and got.agg(F.sum("n")).first()[0] == 60


def test_only_changed_pages_are_written_and_failures_leave_the_last(spark, tmp_path):
    store = Releases(spark, f"file://{tmp_path}/site", 2)
    put = lambda name, df, **how: store.publish(name, df, "doc", ["id"], ["b", "a", "id"], 10, **how)
    assert store.current() is None
    first = put("one", rows(spark))
    assert first == len(made(rows(spark)))
    name, root = store.current()

    def stop(step):
        if step == "pages":
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        put("two", rows(spark, change=7), between=stop)
    with pytest.raises(Refused, match="secret"):
        put("three", rows(spark), refuse={"secret": F.col("b.a") == "x", "fine": F.col("a") < 0})
    with pytest.raises(Refused, match="no rows"):
        put("four", rows(spark).limit(0))
    assert store.current() == (name, root) and store.pages().count() == first
    assert put("five", rows(spark, parts=5)) == 0 and store.current() == ("five", root)
    assert put("six", rows(spark, change=8)) == 1 and store.current()[1] != root  # the stopped one changed row 7
    states = releases.changes(store.pages("one"), store.pages()).groupBy("state").count().collect()
    assert {r.state: r["count"] for r in states} == {"same": first - 1, "changed": 1}
    assert sum(len(json.loads(r.body)["items"]) for r in store.bodies().collect()) == 60


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([("d", None, None, 1.0), ("d", None, None, 1.0), (None, 1, None, 1.0), ("", 1, (None, None), float("nan"))], ROWS)
    got = made(df)
    assert got["d", ""].n == 2 and json.loads(got["d", ""].body)["items"][0] == {"a": 1.0, "b": None, "id": None}
    assert set(got) == {("d", ""), ("", "")} and '"b":{"a":null,"z":null}' in got["", ""].body
    assert made(df.limit(0)) == {} and releases.document_digests(releases.pages_of(df.limit(0), "doc", ["id"], ["a"])).count() == 0
