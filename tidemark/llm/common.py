"""Helpers that several text operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

#: Separators of words, everywhere in this package: space and U+0009 to U+000D.
SPACES = " \\t\\n\\x0B\\f\\r"
#: Bytes of a row group of tables between steps: a writer holds one in memory, and texts are wide.
ROW_GROUP = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def words_of(column: Column) -> Column:
    """Array of the maximal runs of characters that aren't separators."""
    return F.filter(F.split(column, f"[{SPACES}]+"), lambda w: w != "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores as make it unlike any column of df."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where none is set (tests) is a local one made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_scopes: list[list[str]] = []


def materialise(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, and the planner knows its size.

    The shuffle files of a finished write go at once; else they would stay until the driver collects its garbage. Inside
    `tidied` the table goes at the end, unless it is `lasting`, as one must be that a result still reads.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    if _scopes and not lasting:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Deletes at the end what `materialise` wrote inside, but lasting tables."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bound_arrow(spark: SparkSession, size: str = "8m") -> None:
    """Bounds an Arrow batch by bytes, as a count of rows alone doesn't bound very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Slices of at most about `most` code points; a longer text stands alone."""
    start = held = 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield start, k
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def running_total(df: DataFrame, key: str | None, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """df with the running sum of `value` (long) per key in this order, as the column `out`; written to the shared folder.

    Rows are dealt by ranges of key and order, so a key with any share of all rows is spread over tasks. Each task sums
    its own rows; what a key has gathered in the ranges before is one number for each range, the only thing that the
    driver sees. key: a long column without nulls, or None for one sequence of all rows.
    """
    part, last = fresh(df, "part", "last")
    by = [*([F.col(key)] if key else []), *order]
    spread = df.withColumn(out, value.cast("long")).repartitionByRange(*by).sortWithinPartitions(*by)
    names = spread.columns
    bound_arrow(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held, before, carried = None, None, 0

        def flagged(batch: pa.RecordBatch, ended: bool) -> pa.RecordBatch:
            n = batch.num_rows
            flags = np.zeros(n, bool)
            flags[-1] = ended
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, number, np.int32)), pa.array(flags)], names=[*names, part, last])

        for batch in batches:
            if not batch.num_rows:
                continue
            sums = np.cumsum(batch.column(len(names) - 1).to_numpy(zero_copy_only=False))
            keys = batch.column(names.index(key)).to_numpy(zero_copy_only=False) if key else np.zeros(len(sums), np.int64)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            base = np.where(starts > 0, sums[starts - 1], 0)
            if before is not None and keys[0] == before:
                base[0] -= carried
            sums = sums - np.repeat(base, np.diff(np.append(starts, len(sums))))
            before, carried = keys[-1], sums[-1]
            if held is not None:
                yield flagged(held, False)
            held = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums)], names=names)
        if held is not None:
            yield flagged(held, True)

    schema = StructType([*spread.schema.fields, StructField(part, IntegerType()), StructField(last, BooleanType())])
    local = materialise(spread.mapInArrow(run, schema), "running")
    ends = local.where(F.col(last)).select(part, F.col(key) if key else F.lit(0).cast("long"), out).orderBy(part).collect()  # one row a range
    moved, so_far = [], None
    for (_, k, total), (following, *_) in zip(ends, ends[1:], strict=False):
        so_far = (k, total + (so_far[1] if so_far and so_far[0] == k else 0))
        moved.append((following, *so_far))
    if not moved:
        return local.drop(part, last)
    at, of, more = fresh(local, "at", "of", "more")
    before = df.sparkSession.createDataFrame(moved, f"`{at}` int, `{of}` long, `{more}` long")
    same = (F.col(part) == F.col(at)) & ((F.col(key) == F.col(of)) if key else F.lit(True))
    return local.join(F.broadcast(before), same, "left").withColumn(out, F.col(out) + F.coalesce(more, F.lit(0))).select(*names)
