"""Queries of result versions, winners, manifests, quotas and the order of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import policy, versions
from tidemark.plans.queries import T, query
from tidemark.plans.tables import OBS_SQL, cutoff, observations, table


@query(f"""WITH {OBS_SQL}, o AS (SELECT event_id, k, CASE WHEN k % 5 > 0 THEN effective_at END AS e, CASE WHEN k % 7 > 0 THEN observed_at END AS s FROM obs)
  SELECT event_id, coalesce(e < {T}, false) OR coalesce(s <= {T}, false) OR (e IS NULL AND s IS NULL) AS scoped, CAST(floor(epoch(CASE WHEN k % 2 = 0 THEN s ELSE coalesce(e, s) END)) AS BIGINT) AS visible FROM o""")
def fingerprint_scope(spark, d):
    k = F.col("k")
    o = observations(spark, d).select("event_id", "k", F.when(k % 5 > 0, F.col("effective_at")).alias("e"), F.when(k % 7 > 0, F.col("observed_at")).alias("s"))
    at = versions.fact_visible_at(F.when(k % 2 > 0, F.col("e")), F.col("s"), F.lit(None))
    seconds = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at) / 1000000)
    return o.select("event_id", versions.in_fingerprint(F.col("e"), F.col("s"), cutoff()).alias("scoped"), seconds.cast("long").alias("visible"))


@query("""SELECT l.l_orderkey, l.l_linenumber, CASE WHEN o.o_orderkey IS NULL THEN 'unknown' ELSE o.o_orderpriority END AS timestamp_quality, strftime(o.o_orderdate, '%Y-%m-%d') AS published
  FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 > 0) o ON l.l_returnflag = 'N' AND o.o_orderkey = l.l_orderkey""")
def linked_clocks(spark, d):
    none = F.lit(None).cast("timestamp_ntz")
    seen = table(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("timestamp_quality"), none.alias("proxy_published_at"), F.col("o_orderdate").alias("source_published_at"), none.alias("source_updated_at"))
    mine = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("raw_observation_id"), F.when(F.col("l_returnflag") == "N", "linked").otherwise("unknown").alias("provenance_status"))
    return versions.attach_clocks(mine, seen).select("l_orderkey", "l_linenumber", "timestamp_quality", F.date_format("source_published_at", "yyyy-MM-dd").alias("published"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS night, CASE o_orderkey % 5 WHEN 0 THEN 'draw' WHEN 1 THEN 'other' ELSE 'decisive' END AS res, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'b' WHEN 2 THEN 'z' ELSE 'a' END AS w,
    o_orderkey % 3 = 0 AS fa, o_orderkey % 11 = 0 AS fb, o_orderkey % 13 = 0 AS same FROM orders),
  f AS (SELECT *, CASE WHEN res = 'other' THEN 'unknown_result_class' WHEN same THEN 'invalid_participant_set' WHEN res = 'draw' THEN CASE WHEN w IS NOT NULL OR fa OR fb THEN 'non_decisive_has_winner' END WHEN fa AND fb THEN 'duplicate_winner_flag'
    WHEN w IS NULL AND (night OR NOT (fa OR fb)) THEN 'missing_decisive_winner' WHEN w = 'z' THEN 'nonparticipant_winner' WHEN w IS NOT NULL AND (fa OR fb) AND w <> CASE WHEN fa THEN 'a' ELSE 'b' END THEN 'flag_winner_contradiction' END AS refused FROM o)
  SELECT o_orderkey, CASE WHEN refused IS NULL AND res = 'decisive' THEN coalesce(w, CASE WHEN fa THEN 'a' ELSE 'b' END) END AS winner, CASE WHEN refused IS NULL THEN CASE WHEN res = 'draw' THEN 'none' WHEN w IS NOT NULL THEN 'named' ELSE 'flag' END END AS source, refused FROM f""")
def version_winners(spark, d):
    k = F.col("o_orderkey")
    result = F.when(k % 5 == 0, "draw").when(k % 5 == 1, "other").otherwise("decisive")
    winner = F.when(k % 7 == 0, " ").when(k % 7 == 1, " b").when(k % 7 == 2, "z").otherwise("a")
    one = F.struct(F.lit("a").alias("id"), (k % 3 == 0).alias("flagged"))
    two = F.struct(F.when(k % 13 == 0, "a").otherwise("b").alias("id"), (k % 11 == 0).alias("flagged"))
    w = versions.winner_of(F.when(k % 2 == 0, "event_night").otherwise("current"), result, winner, F.array(one, two))
    return table(spark, d, "orders").select("o_orderkey", *[w[c].alias(c) for c in ("winner", "source", "refused")])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'cancelled' WHEN o_orderkey % 4 = 1 THEN 'replacement' WHEN o_orderkey % 2 = 0 THEN 'completed_brazil' ELSE 'completed_standard' END AS category,
  CASE WHEN o_orderstatus = 'F' THEN 'resolved' WHEN o_orderstatus = 'O' THEN 'blocked' ELSE 'unmapped' END AS provider FROM orders""")
def manifest_classes(spark, d):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(k % 7 == 0, "lost").when(k % 4 == 0, " Canceled").when(k % 4 == 1, "replacement").otherwise("occurred")
    m = versions.manifest_class(F.when(k % 2 == 0, "brazil").otherwise("standard"), status, F.when(s == "F", "x"), s == "O")
    return table(spark, d, "orders").select("o_orderkey", m["category"].alias("category"), m["provider"].alias("provider"))


@query(f"""WITH {OBS_SQL}, n AS (SELECT user_id, observed_at AS seen, CASE WHEN k % 9 > 0 THEN k - 5 END AS rest, row_number() OVER (PARTITION BY user_id ORDER BY observed_at DESC, event_id DESC) AS rn FROM obs WHERE observed_at <= {T}),
  s AS (SELECT *, CASE WHEN date_trunc('month', seen) <> date_trunc('month', {T}) THEN 'stale_billing_cycle' WHEN {T} - seen > INTERVAL 86400 SECOND THEN 'stale_max_age' WHEN rest IS NULL THEN 'missing_remaining_header' WHEN rest < 0 THEN 'malformed_negative_remaining' ELSE 'persisted_quota_observation' END AS state FROM n WHERE rn = 1)
  SELECT user_id, CASE WHEN state = 'persisted_quota_observation' THEN rest END AS remaining, state FROM s""")
def remaining_quota(spark, d):
    o = observations(spark, d).withColumn("rest", F.when(F.col("k") % 9 > 0, F.col("k") - 5))
    return versions.remaining_quota(o, "user_id", "observed_at", "event_id", "rest", cutoff(), 86400)


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 7 WHEN '3' THEN 13 WHEN '4' THEN 5 ELSE 999 END, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END, o_orderkey) AS place FROM orders""")
def job_places(spark, d):
    first = F.substring("o_orderpriority", 1, 1)
    job = F.when(first == "1", "discover").when(first == "2", "publish").when(first == "3", "backup").when(first == "4", "score").otherwise("?")
    order = versions.job_order(job, F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")), F.lit(None).cast("string"), F.col("o_orderkey"))
    return policy.numbered(table(spark, d, "orders"), order, "place").select("o_orderkey", "place")
