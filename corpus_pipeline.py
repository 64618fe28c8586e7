"""The corpus pipeline: five stages, each one operator over all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, host_rules, ngram_jaccard, pii_feistel, spaced_seeds
from tidemark.llm.common import ROW_GROUP, materialise, table
from tidemark.llm.queries import TEST_KEY, tokenizer_path


def _narrow(spark: SparkSession) -> None:
    """Small row groups for what the stages return: a writer holds one in memory, and texts are wide."""
    spark.conf.set("parquet.block.size", str(ROW_GROUP))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the rules nor, if they are doubtful, their host's verdict reject; all columns.

    Null, empty and blank texts have too few words and go; long ones are judged whole. A null source is a host of its
    own. Repeated rows share a verdict, ties don't arise, an empty table stays empty; extra columns pass through,
    whatever their names.
    """
    _narrow(spark)
    return host_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id; all columns.

    Null, empty and blank texts have no shingles, link with nothing and stay, as do rows with a null doc_id; long texts
    are compared whole. Rows that share the smallest doc_id all stay, so a repeated row isn't resolved. An empty table
    stays empty; extra columns pass through, whatever their names.
    """
    _narrow(spark)
    return ngram_jaccard.keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; all columns.

    Null, empty and blank texts hold nothing and stay, as do rows with a null doc_id; long texts are searched whole. If
    any row of a doc_id leaks, all rows of it go. An empty table stays empty, and an empty benchmark removes nothing;
    extra columns pass through, whatever their names.
    """
    _narrow(spark)
    return spaced_seeds.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal numbers, dates and addresses as pseudonyms; n_chars follows a text that changed.

    Null texts stay null and empty ones empty; long ones are treated whole. Repeated rows and equal values get equal
    pseudonyms, an empty table stays empty; extra columns pass through, but one called pii_kinds is replaced by the kinds found.
    """
    _narrow(spark)
    done = pii_feistel.pseudonymise(docs, TEST_KEY)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size("pii_kinds") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def byte_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only doc_id, lang and source (those there are), and of every text n_tokens, ids, where each token starts (offsets), and whether decoding gives the text again (round_trip).

    As the last stage it drops the text and all other columns. A null or empty text has no ids and comes back; long ones
    are encoded whole. Repeated rows get equal ids; an empty table stays empty.
    """
    _narrow(spark)
    kept = tuple(c for c in ("doc_id", "lang", "source", "text") if c in docs.columns)
    done = byte_bpe.encode_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"), keep=kept, decoded=True)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return done.select(*(c for c in kept if c != "text"), "n_tokens", "ids", "offsets", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("byte_bpe", byte_tokens),
]

#: The join's components, the keyed permutations and the encoding are beyond SQL; a brute-force version tests them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
