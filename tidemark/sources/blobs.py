"""Payloads by content: stored once under their SHA-256, verified where they lie, and held against what refers to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ledger import PACKED, swept

SCHEMA = "digest string, payload binary, prefix string"


def blobs(spark: SparkSession, root: str) -> DataFrame:
    """digest, payload, prefix (the digest's first two digits, which are folders)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    written = fs.exists(path) and any(s.getPath().getName().startswith("prefix=") for s in fs.listStatus(path))
    return spark.read.schema(SCHEMA).parquet(root) if written else spark.createDataFrame([], SCHEMA)


def put(payloads: DataFrame, root: str, payload: str = "payload") -> int:
    """Adds payloads that the store doesn't have; the number of these. Null payloads are left out, repeated ones count once.

    What is there is found by digests alone; stored payloads aren't read. Payloads are dealt by digest, so a payload that
    comes in many rows is combined before the shuffle.
    """
    rows = payloads.where(F.col(payload).isNotNull()).select(F.sha2(payload, 256).alias("digest"), F.col(payload).cast("binary").alias("payload"))
    new = rows.groupBy("digest").agg(F.any_value("payload").alias("payload")).join(blobs(rows.sparkSession, root).select("digest"), "digest", "left_anti")
    new = new.withColumn("prefix", F.substring("digest", 1, 2))
    before = blobs(rows.sparkSession, root).count()
    with swept(rows.sparkSession):
        new.repartition("prefix").write.options(**PACKED).mode("append").partitionBy("prefix").parquet(root)
    return blobs(rows.sparkSession, root).count() - before


def verified(stored: DataFrame) -> DataFrame:
    """(digest, sound): whether all that lies under a digest is what it says, and under its own prefix."""
    sound = (F.sha2("payload", 256) == F.col("digest")) & (F.substring("digest", 1, 2) == F.col("prefix"))
    return stored.groupBy("digest").agg(F.min(F.coalesce(sound, F.lit(False))).alias("sound"))


def files_verified(spark: SparkSession, pattern: str) -> DataFrame:
    """The same of a tree of plain files that are named by their digests; read in place. Names that are no digests give null."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    digest = F.regexp_extract(name, r"^([0-9a-f]{64})(?:\.[a-z]+)?$", 1)
    rows = spark.read.format("binaryFile").load(pattern).select(F.nullif(digest, F.lit("")).alias("digest"), "content")
    return rows.groupBy("digest").agg(F.min(F.sha2("content", 256) == F.col("digest")).alias("sound"))


STATES = ("absent", "dangling", "missing", "corrupt", "present")


def references(observations: DataFrame, checked: DataFrame) -> DataFrame:
    """The observations with `blob`: absent (refers to nothing), dangling (refers to another payload than it says), missing, corrupt or present.

    observations: raw_ref, payload_hash; checked: digest, sound, as `verified` gives it.
    """
    out = [c for c in observations.columns if c not in ("__digest", "sound")]
    j = observations.join(checked.select(F.col("digest").alias("__digest"), "sound"), F.col("raw_ref") == F.col("__digest"), "left")
    absent = F.coalesce(F.col("raw_ref"), F.lit("")) == ""
    other = F.col("payload_hash").isNotNull() & (F.col("payload_hash") != "") & (F.col("raw_ref") != F.col("payload_hash"))
    state = F.when(absent, "absent").when(other, "dangling").when(F.col("__digest").isNull(), "missing").when(~F.coalesce("sound", F.lit(False)), "corrupt").otherwise("present")
    return j.select(*out, state.alias("blob"))


def integrity(observations: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: n_absent, n_dangling, n_missing, n_corrupt, n_present and ok (nothing dangling, missing or corrupt)."""
    found = references(observations, checked)
    counts = found.agg(*[F.count_if(F.col("blob") == s).alias(f"n_{s}") for s in STATES])
    return counts.withColumn("ok", F.col("n_dangling") + F.col("n_missing") + F.col("n_corrupt") == 0)
