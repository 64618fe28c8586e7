"""Names, keys and scraped cells as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc_name(name: Column) -> Column:
    """NFKC, case folded, single blanks; accents stay. Spark has no NFKC of its own."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.str.normalize("NFKC").str.casefold().str.split().str.join(" ")

    return run(name)


def ascii_name(name: Column) -> Column:
    """The same for names in ASCII, without Python."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def parse_of(cell: Column) -> Column:
    """`x of y` as a struct of both, else zeros."""
    part = lambda k: F.coalesce(F.regexp_extract(cell, r"^\s*(\d+)\s+of\s+(\d+)\s*$", k).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("landed"), part(2).alias("attempted"))


def parse_percent(cell: Column) -> Column:
    return F.regexp_extract(cell, r"^\s*(\d+)%\s*$", 1).try_cast("int") / 100


def parse_clock(cell: Column) -> Column:
    """`m:ss` in seconds, anything else 0."""
    part = lambda k: F.regexp_extract(cell, r"^\s*(\d+):(\d{1,2})\s*$", k).try_cast("int")
    return F.coalesce(part(1) * 60 + part(2), F.lit(0))


def parse_long_date(text: Column) -> Column:
    """`March 5, 2024` or `Mar 5, 2024`, else null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("MMMM d, yyyy")), F.try_to_timestamp(text, F.lit("MMM d, yyyy"))).cast("date")


def identity_key(columns: Sequence[Column]) -> Column:
    """SHA-256 of fields in order; a null isn't dropped but differs from every text."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def csv_tokens(text: Column) -> Column:
    """Distinct trimmed lower-case tokens in order, joined again."""
    tokens = F.transform(F.split(text, ","), lambda t: F.lower(F.trim(t)))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t != ""))), ",")


def redact(message: Column) -> Column:
    return F.regexp_replace(message, r"(?i)(api_?key|token|secret|password)(\s*[=:]\s*)[^\s&,;]+", "$1$2***")


def pair_key(left: Column, right: Column) -> Column:
    """The same for both orders."""
    return F.concat_ws("|", F.least(left, right), F.greatest(left, right))
