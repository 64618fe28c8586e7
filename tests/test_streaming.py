from __future__ import annotations

from datetime import datetime

from tidemark.streaming import ticks

SCHEMA = "k long, at timestamp, v string"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_appends_each_key_once_over_restarts(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    t = datetime(2024, 1, 1)
    put(spark, source, [(1, t, "a"), (1, t, "b"), (2, t, "c")])
    for extra in ([], [(2, t, "again"), (3, t, "d")]):
        if extra:
            put(spark, source, extra)
        ticks.append_once(spark.readStream.schema(SCHEMA).parquet(source), target, ["k"], ["v"], state).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(target).select("k", "v").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_lifecycle_keeps_state_between_batches(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    got: list = []
    for rows in ([(1, datetime(2024, 1, 1), "active"), (1, datetime(2024, 1, 2), "suspended"), (2, datetime(2024, 1, 1), "closed")], [(1, datetime(2024, 1, 3), "replaced"), (1, datetime(2024, 1, 4), "active"), (2, datetime(2024, 1, 5), "active")]):
        put(spark, source, rows)
        out = ticks.lifecycle(spark.readStream.schema(SCHEMA).parquet(source), "k", "at", "v")
        out.writeStream.foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.select("k", "before", "state", "allowed").collect())).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got, key=str) == sorted([(1, None, "active", True), (1, "active", "suspended", True), (2, None, "closed", True), (1, "suspended", "replaced", False), (1, "suspended", "active", True), (2, "closed", "active", False)], key=str)
