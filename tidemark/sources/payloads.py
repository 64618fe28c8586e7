"""Provider JSON: event, bookmakers, markets, outcomes, flattened and told apart from what is absent or malformed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = """id STRING, home_team STRING, away_team STRING, commence_time STRING, bookmakers ARRAY<STRUCT<key: STRING, title: STRING, last_update: STRING,
 markets: ARRAY<STRUCT<key: STRING, last_update: STRING, outcomes: ARRAY<STRUCT<name: STRING, price: DOUBLE, point: DOUBLE>>>>>>"""
#: Books that only average others.
DERIVED = ("consensus", "average", "reference")


def _events(raw: DataFrame, body: str) -> DataFrame:
    return raw.select(F.from_json(body, EVENT).alias("e")).select("e.*").where("id IS NOT NULL")


def malformed(raw: DataFrame, body: str) -> DataFrame:
    """Rows that don't parse to an event with an id."""
    return raw.where(F.from_json(body, EVENT)["id"].isNull())


def _markets(raw: DataFrame, body: str) -> DataFrame:
    books = _events(raw, body).select("id", "home_team", "away_team", "commence_time", F.explode("bookmakers").alias("b")).withColumn("bookmaker_key", F.lower(F.trim("b.key")))
    return books.where(~F.col("bookmaker_key").isin(*DERIVED)).select("id", "home_team", "away_team", "commence_time", "bookmaker_key", F.col("b.last_update").alias("updated"), F.explode_outer("b.markets").alias("m"))


def quotes_of(raw: DataFrame, body: str) -> DataFrame:
    """A row per outcome: the home side is fighter_a, the away side fighter_b."""
    rows = _markets(raw, body).select("*", F.explode("m.outcomes").alias("o"))
    name = F.lower(F.trim("o.name"))
    key = F.when(name == F.lower(F.trim("home_team")), "fighter_a").when(name == F.lower(F.trim("away_team")), "fighter_b").otherwise(name)
    return rows.select("id", "bookmaker_key", F.col("m.key").alias("market"), key.alias("outcome_key"), F.col("o.point").alias("line_point"), F.col("o.price").alias("price"), F.to_timestamp("updated").alias("source_updated_at"), F.to_timestamp("commence_time").alias("commence_time"))


def unknown_of(raw: DataFrame, body: str, requested: Sequence[str]) -> DataFrame:
    """Requested markets that a book didn't give; a book's market that came malformed isn't absent."""
    m = _markets(raw, body)
    want = m.select("id", "bookmaker_key").distinct().withColumn("market", F.explode(F.array(*map(F.lit, requested))))
    return want.join(m.select("id", "bookmaker_key", F.col("m.key").alias("market")).distinct(), ["id", "bookmaker_key", "market"], "left_anti")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a strict schema: a malformed row ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_quarantined(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines: the rows that parse, and the raw text of those that don't."""
    rows = spark.read.schema(f"{schema}, __bad STRING").option("columnNameOfCorruptRecord", "__bad").json(path)
    return rows.where("__bad IS NULL").drop("__bad"), rows.where("__bad IS NOT NULL").select("__bad")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def accept_dump(rows: DataFrame, known: DataFrame, key: str, digest: str, expected: int, share: float = 0.99) -> DataFrame:
    """One row: whether a dump has exactly the expected rows and agrees with known digests in `share` of the common keys."""
    both = rows.select(key, F.col(digest).alias("a")).join(known.select(key, F.col(digest).alias("b")), key)
    agree = both.agg(F.count("*").alias("compared"), F.count_if(F.col("a") == F.col("b")).alias("equal"))
    counted = agree.join(rows.agg(F.count("*").alias("rows")), F.lit(True))  # one row each
    return counted.select("rows", "compared", "equal", ((F.col("rows") == expected) & (F.col("compared") > 0) & (F.col("equal") >= share * F.col("compared"))).alias("accepted"))
