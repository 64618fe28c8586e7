"""Batches are all or nothing, replays add nothing, detail never falls; payloads are counted as they lie."""

from __future__ import annotations

import gzip
import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import blobs, ingest

SCHEMA = "external_id string, payload_hash string, entity_kind string, subject_id string, version_kind string, detail_level string, attributes string, effective_at timestamp_ntz, observed_at timestamp_ntz, seq long"
T = datetime(2024, 1, 1)


def obs(seq, payload, detail="verified", subject="bout", kind="event_night", entity="bout_result", external="x"):
    return (external, payload, entity, subject, kind, detail, f"told by {payload}", T, T, seq)


@pytest.fixture
def store(spark, tmp_path):
    return ingest.Store(spark, f"file://{tmp_path}/store", 4)


def add(store, *rows, token="t", **how):
    return store.apply_batch(store.spark.createDataFrame(list(rows), SCHEMA), "run", "web", "results", "all", "v1", token, **how)


def revisions(store):
    return sorted((r.subject_id, r.version_kind, r.revision, r.payload_hash) for r in store.results().collect())


def counts(c):
    return c.inserted, c.skipped_identical, c.skipped_downgrade


def test_a_replay_adds_nothing(store):
    assert store.observations().count() == store.results().count() == store.checkpoints().count() == 0
    assert counts(add(store, obs(1, "a"), obs(2, "a"), token="1")) == (1, 1, 0)
    assert counts(add(store, obs(1, "a"), token="2")) == (0, 1, 0)
    assert store.observations().count() == 1 and revisions(store) == [("bout", "event_night", 1, "a")]
    assert [(r.source, r.version, r.token) for r in store.checkpoints().collect()] == [("web", "v1", "2")]
    assert counts(store.apply_batch(store.spark.createDataFrame([obs(1, "a")], SCHEMA), "run", "web", "results", "other", "v1", "o")) == (1, 0, 0)


def test_a_correction_is_a_new_version(store):
    add(store, obs(1, "night"))
    add(store, obs(2, "changed", kind="current"), obs(3, "changed again", kind="current"), obs(4, "night two"))
    assert revisions(store) == [("bout", "current", 1, "changed"), ("bout", "current", 2, "changed again"), ("bout", "event_night", 1, "night"), ("bout", "event_night", 2, "night two")]


def test_detail_never_falls(store):
    assert counts(add(store, obs(1, "s1", "summary"))) == (1, 0, 0)
    assert counts(add(store, obs(2, "v", "verified"))) == (1, 0, 0)
    assert counts(add(store, obs(3, "s2", "summary"), obs(4, "p", "partial"), obs(5, "v2"))) == (3, 0, 2)
    assert revisions(store) == [("bout", "event_night", 1, "s1"), ("bout", "event_night", 2, "v"), ("bout", "event_night", 3, "v2")]
    # In one batch the first stands, and what tells less than another of the batch falls behind it.
    assert counts(add(store, obs(1, "a", "summary", "other"), obs(2, "b", "summary", "other"), obs(3, "c", "partial", "other"), obs(4, "n", None, "other"))) == (4, 0, 2)
    assert [x[3] for x in revisions(store) if x[0] == "other"] == ["a", "c"]
    assert counts(add(store, obs(1, "e", entity="event"), obs(2, "f", subject=None), obs(3, "g", kind=None))) == (3, 0, 0)


@pytest.mark.parametrize("step", ["observations", "results"])
def test_a_batch_that_stops_leaves_nothing_visible(store, step):
    add(store, obs(1, "ok"), token="ok")

    def stop(at):
        if at == step:
            raise OSError("stopped")

    with pytest.raises(OSError, match="stopped"):
        add(store, obs(2, "lost"), token="lost", between=stop)
    again = ingest.Store(store.spark, store.root, 4)  # a reader after a restart
    assert revisions(again) == [("bout", "event_night", 1, "ok")] and again.observations().count() == 1
    assert again.checkpoints().first().token == "ok"
    assert counts(add(again, obs(2, "lost"), token="new")) == (1, 0, 0) and len(again.sweep()) == 1 and not again.sweep()
    assert revisions(again)[-1] == ("bout", "event_night", 2, "lost") and again.checkpoints().first().token == "new"


def test_of_two_writers_one_must_begin_again(store):
    add(store, obs(1, "a"))
    with pytest.raises(ingest.Conflict):
        add(store, obs(2, "slow"), between=lambda step: add(store, obs(3, "fast")) if step == "results" else None)
    assert [x[3] for x in revisions(store)] == ["a", "fast"]
    assert counts(add(store, obs(2, "slow"))) == (1, 0, 0) and [x[3] for x in revisions(store)] == ["a", "fast", "slow"]


def test_an_empty_batch_moves_the_checkpoint(store):
    assert counts(add(store, token="1")) == (0, 0, 0)
    assert counts(add(store, obs(1, "a"), token="2")) == (1, 0, 0) and store.checkpoints().first().token == "2"


# ---- payloads


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_payloads_are_stored_once_and_counted_as_they_lie(spark, tmp_path):
    root = f"file://{tmp_path}/blobs"
    df = spark.createDataFrame([(b"one",), (b"two",), (b"one",), (b"",), (None,), (b"x" * 100_000,)], "payload binary")
    assert blobs.blobs(spark, root).count() == 0 and blobs.put(df, root) == 4 and blobs.put(df, root) == 0
    assert blobs.put(spark.createDataFrame([(b"three",), (b"two",)], "payload binary"), root) == 1
    assert {r.digest: bytes(r.payload) for r in blobs.blobs(spark, root).collect()}[sha(b"two")] == b"two"
    bad, wrong = sha(b"bad"), sha(b"wrong place")
    spark.createDataFrame([(bad, b"not bad", bad[:2])], blobs.SCHEMA).write.mode("append").partitionBy("prefix").parquet(root)
    spark.createDataFrame([(wrong, b"wrong place", "zz")], blobs.SCHEMA).write.mode("append").partitionBy("prefix").parquet(root)
    refs = [(sha(b"one"), sha(b"one")), (sha(b"two"), None), (sha(b"two"), ""), (None, sha(b"one")), ("", None), (sha(b"one"), sha(b"two")), (sha(b"never"), sha(b"never")), (bad, bad), (wrong, wrong)]
    seen = spark.createDataFrame([(*r, True) for r in refs], "raw_ref string, payload_hash string, sound boolean")
    got = blobs.integrity(seen.drop("sound"), blobs.verified(blobs.blobs(spark, root))).first().asDict()
    assert got == {"n_absent": 2, "n_dangling": 1, "n_missing": 1, "n_corrupt": 2, "n_present": 3, "ok": False}
    assert blobs.integrity(seen.drop("sound").where(F.col("raw_ref") == sha(b"one")).where("payload_hash = raw_ref"), blobs.verified(blobs.blobs(spark, root))).first().ok


def test_files_are_verified_in_place(spark, tmp_path):
    for data, name in ((b"a", sha(b"a")), (b"b", sha(b"not b") + ".bin"), (gzip.compress(b"c"), "notes.txt")):
        (tmp_path / name[:2]).mkdir(exist_ok=True)
        (tmp_path / name[:2] / name).write_bytes(data)
    assert {r.digest: r.sound for r in blobs.files_verified(spark, f"file://{tmp_path}/*/*").collect()} == {sha(b"a"): True, sha(b"not b"): False, None: None}
