"""Quality rules of a document, and of its host.

A document fails on its own by the base rules, and is doubtful by two weaker ones. Both are counted by host, the hosts'
rates are shrunk towards an empirical beta prior (so a host with two documents isn't condemned by one), and a host that
is worse than the average by a margin, almost surely, lends its verdict to its doubtful documents. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, fresh, materialise, text_of, words_of

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"


def _let(value: Column, use) -> Column:
    """use(value), the value being made once, also where the planner copies the expression into a filter."""
    return F.get(F.transform(F.array(value), use), 0)


def _covered(grams: Column) -> Column:
    """How many words lie in windows that occur twice or more; grams are sorted structs (g, i) of hashed windows."""
    last = F.size(grams) - 1
    same = lambda x, k: F.get(grams, k)["g"] == x["g"]
    twice = F.filter(grams, lambda x, i: ((i > 0) & same(x, i - 1)) | ((i < last) & same(x, i + 1)))
    gaps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda p: F.aggregate(gaps(p), F.lit(0), lambda a, x: a + x))


def metrics(text: str | Column = "text") -> Column:
    """A struct of METRICS of a whole text; a null text has none of anything.

    n_repeat_words counts the words that lie in any 3-word window which the text has twice or more, the first included;
    windows are compared by 64-bit hashes.
    """
    t = text_of(text)
    grams = lambda w: F.sort_array(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))
    words = _let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _let(grams(w), _covered).cast("long").alias("r")))
    dup = _let(F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACES}]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    chars = F.length(F.regexp_replace(t, f"[{SPACES}]+", "")).cast("long")
    symbols = (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")
    return _let(words, lambda w: F.struct(w["n"].alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup.cast("long").alias("n_dup_lines"), w["r"].alias("n_repeat_words")))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def doubtful(m: Column) -> Column:
    """Not enough to reject a document, but enough to believe a bad host: one symbol to three words, or a third of repeats."""
    return (3 * m["n_symbols"] > m["n_words"]) | (3 * m["n_repeat_words"] > m["n_words"])


def host_verdicts(judged: DataFrame, host: str = "source", failed: str = "failed", sure: float = 0.95, margin: float = 0.1) -> DataFrame:
    """One row for each host: host, documents, failures, shrunk_rate, p_worse, host_rejected.

    The prior Beta(a, b) has the mean of all documents and the strength that the spread of the hosts' rates implies
    (method of moments over hosts with two documents or more; without any spread the prior weighs 1000 documents, with
    extreme spread 1). p_worse is the posterior probability, in normal approximation, that the host's rate is above that
    mean by more than `margin`; hosts that reach `sure` are rejected, whatever their size: a small one stays near the
    prior. Where hosts don't differ, none is. A null host is a host of its own. Only one row
    of sums goes to the driver.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("documents"), F.sum(F.col(failed).cast("long")).alias("failures"))
    hosts = materialise(hosts, "host-counts", lasting=True)
    rate = F.col("failures") / F.col("documents")
    many = F.col("documents") > 1
    sums = hosts.agg(
        F.sum("documents").alias("n"), F.sum("failures").alias("f"), F.sum(F.when(many, 1.0)).alias("hosts"), F.sum(F.when(many, rate)).alias("r"), F.sum(F.when(many, rate * rate)).alias("rr"),
        F.sum(F.when(many, 1 / F.col("documents"))).alias("inv"),
    ).first()
    mean = (sums.f or 0) / sums.n if sums.n else 0.0
    strength = 1000.0
    if sums.hosts and 0 < mean < 1:
        spread = max(0.0, sums.rr / sums.hosts - (sums.r / sums.hosts) ** 2 - mean * (1 - mean) * sums.inv / sums.hosts)
        strength = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1000.0
    out = hosts.withColumn("shrunk_rate", (F.lit(mean * strength) + F.col("failures")) / (F.lit(strength) + F.col("documents")))
    deviation = F.sqrt(F.col("shrunk_rate") * (1 - F.col("shrunk_rate")) / (F.lit(strength + 1) + F.col("documents")))
    z = F.when(deviation > 0, (F.col("shrunk_rate") - (mean + margin)) / deviation).otherwise(0.0)
    p_worse = F.lit(0.5) * (1 + F.signum(z) * F.sqrt(1 - F.exp(-2 * z * z / F.lit(math.pi))))  # the normal distribution function, within 0.002
    return out.withColumn("p_worse", p_worse).withColumn("host_rejected", F.col("p_worse") >= sure)


def _rejected(counted: DataFrame, sure: float, margin: float) -> DataFrame:
    """The rejected ones of counted (host, failed)."""
    return materialise(host_verdicts(counted, "host", "failed", sure, margin).where("host_rejected").select("host"), "hosts-rejected", lasting=True)


def _with_verdict(df: DataFrame, bad: DataFrame, host: str, verdict: str) -> DataFrame:
    """df with whether its host is rejected. Hosts that aren't need no row in the join; the planner broadcasts the rejected ones if their measured size allows, else splits hot hosts."""
    (own,) = fresh(df, "rejected_host")
    joined = df.join(bad.select(F.struct("host").alias(own)), df[host].eqNullSafe(F.col(own)["host"]), "left")
    return joined.withColumn(verdict, F.col(own).isNotNull()).drop(own)


def judge_documents(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), host: str = "source", text: str = "text", sure: float = 0.95, margin: float = 0.1) -> DataFrame:
    """The columns `keep`, the metrics, base_failed, host_rejected and kept, a row for each row of df.

    kept is false where the base rules fail, and where the document is doubtful and its host rejected: a host counts as
    failures what fails the base rules or is doubtful. So a doubtful document has the benefit of the doubt on a host that
    is as good as others. Null texts have no words, so they fail; a null host is a host of its own; repeated rows are
    judged alike; an empty table stays empty; columns that aren't kept don't matter, kept ones that are called like a
    result are refused. Texts are read once: their metrics are written before hosts are counted.
    """
    if clash := set(keep) & {*METRICS, "base_failed", "host_rejected", "kept"}:
        raise ValueError(f"columns {sorted(clash)} are results; rename them before")
    own = df.select(F.struct(*keep).alias("given"), F.col(host).alias("host"), metrics(text).alias("m"))
    own = materialise(own.withColumns({"base": base_failed(F.col("m")), "doubt": doubtful(F.col("m"))}), "metrics", lasting=True)
    out = _with_verdict(own, _rejected(own.select("host", (F.col("base") | F.col("doubt")).alias("failed")), sure, margin), "host", "verdict")
    return out.select("given.*", "m.*", F.col("base").alias("base_failed"), F.col("verdict").alias("host_rejected"), (~F.col("base") & ~(F.col("verdict") & F.col("doubt"))).alias("kept"))


def keep_documents(df: DataFrame, host: str = "source", text: str = "text", sure: float = 0.95, margin: float = 0.1) -> DataFrame:
    """The rows of df that judge_documents keeps, whole, whatever their other columns are called. Texts are judged twice, for the hosts and for themselves, as that costs less than to write or shuffle them."""
    bad = _rejected(df.select(F.col(host).alias("host"), _let(metrics(text), lambda m: base_failed(m) | doubtful(m)).alias("failed")), sure, margin)
    (verdict,) = fresh(df, "verdict")
    kept = _let(metrics(text), lambda m: ~base_failed(m) & ~(F.col(verdict) & doubtful(m)))
    return _with_verdict(df, bad, host, verdict).where(kept).select(*df.columns)
