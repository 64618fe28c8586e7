"""Append-only ledgers: what is there is never changed, and an append can be repeated."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where none is set (tests) is a local one made."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top


#: How tables of the shared folder are packed: about half of what the default leaves.
PACKED = {"compression": "zstd"}


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Within it shuffle files go with the job that wrote them; else they lie until the driver's next collection of garbage, step upon step."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sweeping(step: Callable) -> Callable:
    """A method of something with a session, whose jobs all end within it."""

    @functools.wraps(step)
    def run(self, *args, **how):
        with swept(self.spark):
            return step(self, *args, **how)

    return run


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Written to the shared folder and read again, so that its rows don't change under later steps; in folders by a column, if one is named."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).options(**PACKED).parquet(path)
    names = [c for c in df.columns if c != by] + [by] * bool(by)
    return df.sparkSession.read.schema(df.select(*names).schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that `stored` gave, when nothing reads them any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for top in {re.match(r"(.*/[^/]+-[0-9a-f]{32})/", f)[1] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(conf).delete(path, True)


def to_append(ledger: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of the batch whose key the ledger doesn't have, the first of each key."""
    first = batch.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")
    return first.join(ledger.select(*key).distinct(), list(key), "left_anti")


def contradictions(ledger: DataFrame, batch: DataFrame, key: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Keys that come again with other content; must be empty."""
    same = lambda df, name: df.select(*key, F.xxhash64(*content).alias(name)).distinct()
    return same(ledger, "__a").join(same(batch, "__b"), list(key)).where("__a <> __b").select(*key).distinct()


def next_revisions(ledger: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str], revision: str = "revision") -> DataFrame:
    """Numbers the batch's rows of a key on from the ledger's last."""
    last = ledger.groupBy(*key).agg(F.max(revision).alias("__last"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return batch.withColumn("__n", place).join(last, list(key), "left").withColumn(revision, (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("long")).drop("__last", "__n")


def upsert_latest(target: DataFrame, changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of target and changes together the last row of each key."""
    rest = [c for c in target.columns if c not in key]
    both = target.unionByName(changes.select(*target.columns))
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__v")).select(*key, "__v.*")


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """An order-independent digest of all rows: their count, and the exclusive or and sum of 48-bit hashes, combined before the shuffle. The hash is an md5's, so that other engines can make it; nulls are left out of a row. The sum is a decimal: that of some 65,000 rows may be past a long."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, 12), 16, 10).cast("long")
    return rows.select(h.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(15,0)")).cast("decimal(38,0)").alias("s"))
