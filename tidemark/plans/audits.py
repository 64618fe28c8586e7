"""Queries of the leakage audits: events as facts, features by user and type, and a table that looks past the cutoff in one column."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import leakage, scores
from tidemark.operators.leakage import Mutation
from tidemark.plans.queries import T, query, r
from tidemark.plans.tables import OBS_SQL, cutoff, observations, table

KEYS = ("user_id", "event_type")


def facts(spark, d):
    return observations(spark, d).select("event_id", *KEYS, "k", "effective_at", "observed_at")


def honest(df):
    known = df.where((F.col("effective_at") < cutoff()) & (F.col("observed_at") <= cutoff()))
    return known.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("effective_at").alias("last"), F.sum("k").alias("total"))


def leaky(df):
    """The total doesn't ask when a fact was observed."""
    seen = F.col("observed_at") <= cutoff()
    return df.where(F.col("effective_at") < cutoff()).groupBy(*KEYS).agg(F.count_if(seen).alias("n"), F.max(F.when(seen, F.col("effective_at"))).alias("last"), F.sum("k").alias("total"))


def _late(df):
    """Of each 97th fact another version, observed after the cutoff."""
    return df.unionByName(df.where("event_id % 97 = 0").withColumns({"event_id": F.col("event_id") + 10**9, "k": F.col("k") + 1, "observed_at": F.greatest("observed_at", cutoff()) + F.expr("INTERVAL 1 SECOND")}))


_HONEST = f"SELECT user_id, event_type, count(*) AS n, max(effective_at) AS last, sum(k) AS total FROM {{0}} WHERE effective_at < {T} AND observed_at <= {T} GROUP BY ALL"
_LEAKY = f"SELECT user_id, event_type, count(*) FILTER (observed_at <= {T}) AS n, max(effective_at) FILTER (observed_at <= {T}) AS last, sum(k) AS total FROM {{0}} WHERE effective_at < {T} GROUP BY ALL"
_TABLES = f"""WITH {OBS_SQL}, f AS (SELECT event_id, user_id, event_type, k, effective_at, observed_at FROM obs),
late AS (SELECT * FROM f UNION ALL SELECT event_id + 1000000000, user_id, event_type, k + 1, effective_at, greatest(observed_at, {T}) + INTERVAL 1 SECOND FROM f WHERE event_id % 97 = 0),
fewer AS (SELECT * FROM f WHERE event_id % 97 <> 0), odd AS (SELECT * FROM f WHERE user_id % 2 = 1),
h AS ({_HONEST.format("f")}), h_late AS ({_HONEST.format("late")}), h_fewer AS ({_HONEST.format("fewer")}), h_odd AS ({_HONEST.format("odd")}), h_own AS (SELECT * FROM h WHERE user_id % 2 = 1), l AS ({_LEAKY.format("f")}), l_late AS ({_LEAKY.format("late")})"""
_COLUMNS = """SELECT '{0}' AS "check", (n = 0) = {3} AS passed, n AS n_columns FROM (SELECT coalesce(bool_or(a.user_id IS NULL OR b.user_id IS NULL), false)::BIGINT + coalesce(bool_or(a.n IS DISTINCT FROM b.n), false)::BIGINT + coalesce(bool_or(a.last IS DISTINCT FROM b.last), false)::BIGINT
  + coalesce(bool_or(a.total IS DISTINCT FROM b.total), false)::BIGINT AS n FROM {1} a FULL JOIN {2} b ON a.user_id = b.user_id AND a.event_type = b.event_type)"""


@query(_TABLES + " " + " UNION ALL ".join(_COLUMNS.format(*x) for x in (("future", "h", "h_late", "true"), ("known", "h", "h_fewer", "false"), ("other users", "h_own", "h_odd", "true"), ("leaky future", "l", "l_late", "true"))))
def leakage_audits(spark, d):
    """Later versions may not change an honest table, known facts must, other users' may not; a table with a leak fails."""
    f, own = facts(spark, d), F.col("user_id") % 2 == 1
    checks = {"future": Mutation(_late), "known": Mutation(lambda df: df.where("event_id % 97 <> 0"), same=False), "other users": Mutation(lambda df: df.where(own), scope=own)}
    both = leakage.audit(honest, f, checks, KEYS).unionByName(leakage.audit(leaky, f, {"leaky future": Mutation(_late)}, KEYS))
    return both.select("check", "passed", "n_columns")


@query(_TABLES + " SELECT user_id, event_type, 'total' AS \"column\", CAST(a.total AS VARCHAR) AS before, CAST(b.total AS VARCHAR) AS after FROM l a JOIN l_late b USING (user_id, event_type) WHERE a.total <> b.total")
def leakage_cells(spark, d):
    """Every cell that a leak changed, by key and column."""
    f = facts(spark, d)
    return leakage.changed_cells(leaky(f), leaky(_late(f)), KEYS)


@query("""WITH x AS (SELECT l_linenumber, year(l_shipdate) AS y, l_returnflag AS f, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS priced FROM lineitem)
SELECT dimension, measure, CAST(total AS BIGINT) AS total, CAST(slices AS BIGINT) AS slices, total = slices AS ok FROM (
  SELECT 'year' AS dimension, 'rows' AS measure, count(*) AS total, count(y) AS slices FROM x UNION ALL SELECT 'year', 'priced', sum(priced), sum(priced) FILTER (y IS NOT NULL) FROM x
  UNION ALL SELECT 'flag', 'rows', count(*), count(*) FILTER (f <> 'R') + count(*) FILTER (l_linenumber = 1) FROM x UNION ALL SELECT 'flag', 'priced', sum(priced), sum(priced) FILTER (f <> 'R') + sum(priced) FILTER (l_linenumber = 1) FROM x)""")
def breakdown_reconciliation(spark, d):
    """Years are a partition of the lines; flags without R, beside the first lines, are none."""
    line = table(spark, d, "lineitem")
    flags = F.filter(F.array(F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")), F.when(F.col("l_linenumber") == 1, "first")), lambda x: x.isNotNull())
    return scores.reconciliation(line, {"year": F.array(F.year("l_shipdate")), "flag": flags}, {"rows": F.lit(1), "priced": F.col("l_discount") > 0.05})


@query("""SELECT l_returnflag, count(*) AS n, round(-avg(ln(greatest(CASE l_returnflag WHEN 'A' THEN l_discount / 2 + 0.1 WHEN 'R' THEN l_discount / 2 + 0.2 ELSE 0.7 - l_discount END, 1e-15))), 6) AS nll FROM lineitem GROUP BY 1""")
def terminal_losses(spark, d):
    """The loss of each flag's lines under chances that the discount gives."""
    x, flag = F.col("l_discount"), F.col("l_returnflag")
    chances = F.create_map(F.lit("A"), x / 2 + 0.1, F.lit("R"), x / 2 + 0.2, F.lit("N"), 0.7 - x)
    line = table(spark, d, "lineitem").select(chances.alias("chances"), flag.alias("flag"))
    each = [scores.terminal_log_loss(line.where(F.col("flag") == f), "chances", "flag").select(F.lit(f).alias("l_returnflag"), "n", r("nll").alias("nll")) for f in ("A", "N", "R")]
    return each[0].unionByName(each[1]).unionByName(each[2]).where("n > 0")
