"""Ticks as Structured Streaming: idempotent appends, anchored windows, a lifecycle machine as state.

Late facts are appended and stay invisible to earlier cutoffs, as their observed time says so; a watermark only bounds
state, it never drops what a later batch query would see.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.ledger import to_append
from tidemark.operators.schedule import MOVES


def append_once(stream: DataFrame, target: str, key: Sequence[str], order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Appends each key once to the Parquet table at target. A batch that is run again finds its keys there and adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            ledger = spark.read.schema(batch.schema).parquet(target)
            ledger.schema  # resolves the path
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            ledger = spark.createDataFrame([], batch.schema)
        to_append(ledger, batch, key, order).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def slot_counts(stream: DataFrame, time: str, width: str, by: Sequence[str], late: str, anchor: str = "0 seconds") -> DataFrame:
    """Rows per window of `width`, begun at `anchor` past the epoch; state is kept for `late` behind the newest row."""
    w = F.window(time, width, width, anchor)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("slot"), *by, "n")


def totals(stream: DataFrame, label: str) -> DataFrame:
    """Runs an aggregate over what is there now and returns its final rows from the shared folder."""
    spark = stream.sparkSession
    from tidemark.operators.ledger import stored

    stored(spark.range(0), label)  # makes sure that a shared folder is set
    top = f"{spark.conf.get('spark.checkpoint.dir')}/{label}-{uuid.uuid4().hex}"
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{top}/rows")
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/rows")


def lifecycle(stream: DataFrame, key: str, time: str, state: str) -> DataFrame:
    """(key, time, before, state, allowed) of each row, in time order within a micro-batch; the last allowed state is kept for each key.

    A key's rows of one micro-batch are sorted together, so the source's rate bounds them (maxFilesPerTrigger and the like).
    """
    kind = stream.schema[key].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get[0] if held.exists else None
        out = []
        for at, new in pd.concat(list(frames)).sort_values(time, kind="stable")[[time, state]].itertuples(index=False):
            ok = now is None or now == new or new in MOVES.get(now, ())
            out.append((k[0], at, now, new, ok))
            now = new if ok else now
        yield pd.DataFrame(out, columns=[key, "at", "before", "state", "allowed"])
        if now is not None:
            held.update((now,))

    return stream.select(key, time, state).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, at timestamp, before string, state string, allowed boolean", "now string", "append", GroupStateTimeout.NoTimeout)
