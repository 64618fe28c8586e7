"""Further queries: eligibility, matching, publications, walk-forward calibration, bootstrap refits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import odds, text
from tidemark.operators import asof, eligibility, ledger, models, quality, resample
from tidemark.plans.queries import OBS_SQL, T, _scored, query, r
from tidemark.plans.tables import BETS_SQL, bets, cutoff, observations, table


@query(f"""WITH {OBS_SQL}, q AS (SELECT *, CASE WHEN k % 5 = 0 THEN NULL ELSE user_id END AS alias_bout, CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ambiguous' ELSE 'matched' END AS ms, CASE WHEN k % 11 = 0 THEN user_id + 1 ELSE user_id END AS mb,
    CASE WHEN k % 13 = 0 THEN 'ambiguous' ELSE '' END AS cs, CASE WHEN event_type = 'error' THEN 'closed' ELSE 'active' END AS bs, CASE WHEN event_type = 'view' AND k % 2 = 0 THEN 'locked' END AS ss,
    CASE WHEN user_id % 9 = 0 THEN TIMESTAMP '2024-01-16 10:00:00' END AS ua, CASE WHEN k % 17 = 0 THEN 'withdrawn' ELSE 'available' END AS av FROM obs)
  SELECT event_id, CASE WHEN NOT observed_at <= {T} THEN 'not_visible' WHEN alias_bout IS NULL OR ms IS NULL THEN 'unmatched' WHEN ms <> 'matched' THEN 'latest_match_not_matched' WHEN mb <> alias_bout THEN 'alias_bout_mismatch' WHEN cs <> '' THEN 'caller_match_restrict'
    WHEN bs = 'closed' THEN 'bout_terminal' WHEN ss = 'locked' THEN 'selection_locked' WHEN ua IS NOT NULL AND observed_at <= ua THEN 'market_unknown' WHEN av <> 'available' THEN 'quote_unavailable' WHEN observed_at < {T} - INTERVAL 360 MINUTE THEN 'stale' END AS reason FROM q""")
def eligibility_ladder(spark, d):
    k, none = F.col("k"), F.lit(None)
    q = {
        "observed_at": F.col("observed_at"), "updated_at": none.cast("timestamp_ntz"), "lower": none.cast("timestamp_ntz"), "alias_bout": F.when(k % 5 != 0, F.col("user_id")),
        "match_status": F.when(k % 7 == 1, "ambiguous").when(k % 7 != 0, "matched"), "match_bout": F.when(k % 11 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")),
        "caller_status": F.when(k % 13 == 0, "ambiguous").otherwise(""), "caller_bout": none.cast("long"), "bout_state": F.when(F.col("event_type") == "error", "closed").otherwise("active"),
        "selection_state": F.when((F.col("event_type") == "view") & (k % 2 == 0), "locked"), "unknown_at": F.when(F.col("user_id") % 9 == 0, F.lit("2024-01-16 10:00:00").cast("timestamp_ntz")),
        "availability": F.when(k % 17 == 0, "withdrawn").otherwise("available"),
    }
    return observations(spark, d).select("event_id", eligibility.ladder(q, cutoff()).alias("reason"))


@query("""WITH s AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'error'), q AS (SELECT event_id AS q, user_id, ts AS t FROM events WHERE event_type = 'click'),
  j AS (SELECT q, s.event_id AS e, s.value AS v, row_number() OVER (PARTITION BY q ORDER BY s.ts DESC, s.event_id DESC) rn FROM q LEFT JOIN s ON q.user_id = s.user_id AND s.ts <= t) SELECT q, round(v, 4) AS state FROM j WHERE rn = 1""")
def states_as_of(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    q = e.where("event_type = 'click'").select(F.col("event_id").alias("q"), "user_id", F.col("ts").alias("t"))
    out = eligibility.with_states(q, ["user_id"], "t", {"state": (e.where("event_type = 'error'"), "ts", "value", "event_id")})
    return out.select("q", r("state", 4).alias("state"))


@query("""WITH e AS (SELECT event_id AS event, user_id AS u, user_id + 1 AS v, ts AS at_t FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id AS bout, user_id + 1 AS u, user_id AS v, ts AS at_t FROM events WHERE event_id % 2 = 1),
  h AS (SELECT event, count(*) AS n, min(bout) AS one FROM e JOIN b ON e.u = b.v AND e.v = b.u AND abs(date_diff('microsecond', e.at_t, b.at_t)) // 1000000 <= 1800 GROUP BY 1)
  SELECT event, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status, CASE WHEN n = 1 THEN one END AS bout, coalesce(n, 0) AS candidates FROM (SELECT event FROM e) LEFT JOIN h USING (event)""")
def event_matching(spark, d):
    e = table(spark, d, "events")
    u, v = F.col("user_id").cast("string"), (F.col("user_id") + 1).cast("string")
    events = e.where("event_id % 2 = 0").select(F.col("event_id").alias("event"), F.concat(F.lit(" P"), u).alias("left"), F.concat(F.lit("p"), v).alias("right"), F.col("ts").alias("at"))
    bouts = e.where("event_id % 2 = 1").select(F.col("event_id").alias("bout"), F.concat(F.lit("p"), v).alias("left"), F.concat(F.lit("P"), u).alias("right"), F.col("ts").alias("at"))
    return eligibility.match_events(events, bouts)


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders) WHERE rn = 1""")
def latest_publication(spark, d):
    return eligibility.latest(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@query("""WITH x AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'line_change' WHEN 'error' THEN 'stale_line' WHEN 'view' THEN 'card_change' ELSE 'other' END AS kind, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
  SELECT user_id, arg_max(CASE WHEN kind IN ('line_change', 'stale_line') THEN k - 1 END, {'a': ts, 'b': event_id}) FILTER (WHERE kind IN ('line_change', 'stale_line')) AS movement,
  CASE WHEN bool_or(kind = 'stale_line') THEN 'stale' WHEN bool_or(kind = 'line_change') THEN 'fresh' ELSE 'unknown' END AS freshness, CAST(sum(CASE WHEN kind = 'card_change' THEN 1 ELSE 0 END) AS BIGINT) AS card_changes FROM x GROUP BY user_id""")
def line_movements(spark, d):
    t = F.col("event_type")
    kind = F.when(t == "click", "line_change").when(t == "error", "stale_line").when(t == "view", "card_change").otherwise("other")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", kind.alias("kind"), F.to_json(F.struct(F.get_json_object("props", "$.k").cast("double").alias("new_decimal"), F.lit(1.0).alias("old_decimal"))).alias("payload"))
    return eligibility.line_movement(e, "user_id", "ts", "event_id", "kind", "payload")


@query(f"""WITH {BETS_SQL}, p AS (SELECT o_orderkey, o_orderpriority AS lane, o_orderstatus FROM orders), s AS (SELECT l_orderkey, sum(CASE WHEN settlement <> 'PUSH' THEN profit END) AS profit, count(*) AS n FROM bets GROUP BY 1)
  SELECT lane, count(*) AS publications, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS confirmed, CAST(coalesce(sum(n), 0) AS BIGINT) AS settlements, round(sum(profit), 4) AS profit_sum FROM p LEFT JOIN s ON o_orderkey = l_orderkey GROUP BY lane""")
def lane_performance(spark, d):
    """Settlements are summed per publication before the join, so that nothing fans out."""
    s = bets(spark, d).groupBy("l_orderkey").agg(F.sum(F.when(F.col("settlement") != "PUSH", F.col("profit"))).alias("profit"), F.count("*").alias("n"))
    p = table(spark, d, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return p.groupBy(F.col("o_orderpriority").alias("lane")).agg(F.count("*").alias("publications"), F.count_if(F.col("o_orderstatus") == "F").alias("confirmed"), F.coalesce(F.sum("n"), F.lit(0)).alias("settlements"), r(F.sum("profit"), 4).alias("profit_sum"))


@query(f"""WITH {BETS_SQL} SELECT year(l_shipdate) AS season, count(*) AS n, round(sum(profit) / count(*), 6) AS roi, round(avg(CASE WHEN settlement = 'WIN' THEN 1.0 WHEN settlement = 'LOSS' THEN 0.0 END), 6) AS hit_rate FROM bets GROUP BY 1""")
def betting_metrics(spark, d):
    s = F.col("settlement")
    return bets(spark, d).groupBy(F.year("at").alias("season")).agg(F.count("*").alias("n"), r(F.sum("profit") / F.count("*")).alias("roi"), r(F.avg(F.when(s == "WIN", 1.0).when(s == "LOSS", 0.0))).alias("hit_rate"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice AS profit, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders""")
def running_profit(spark, d):
    from tidemark.operators import paths

    return paths.running(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "running").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("profit"), r("running", 2).alias("running"))


@query("""SELECT n_regionkey, n_name, CAST(count(DISTINCT s_suppkey) AS BIGINT) AS suppliers, grouping_id(n_regionkey, n_name) AS level FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)""".replace("grouping_id(n_regionkey, n_name)", "CAST(grouping(n_regionkey, n_name) AS BIGINT)"))
def coverage_rollup(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_regionkey", "n_name").agg(F.countDistinct("s_suppkey").alias("suppliers"), F.grouping_id().alias("level"))


@query("""SELECT o_orderstatus AS status, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS BIGINT) AS urgent, CAST(sum(CASE WHEN o_orderpriority LIKE '5%' THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders GROUP BY 1""")
def status_matrix(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.substring("o_orderpriority", 1, 1))
    return o.groupBy(F.col("o_orderstatus").alias("status")).pivot("p", ["1", "5"]).count().select("status", F.coalesce(F.col("1"), F.lit(0)).alias("urgent"), F.coalesce(F.col("5"), F.lit(0)).alias("low"))


@query("""SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform(string_split(lower(replace(o_orderpriority, ' ', ',')) || ', b ,a', ','), lambda x: trim(x)))), ',') AS tokens FROM orders""".replace("list_sort(", "list_sort(list_filter(").replace("lambda x: trim(x)))", "lambda x: trim(x))), lambda x: x <> '')").replace(", ',') AS tokens", ", ',') AS tokens"))
def idempotency_tokens(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.csv_tokens(F.concat(F.regexp_replace("o_orderpriority", " ", ","), F.lit(", b ,A"))).alias("tokens"))


@query("""SELECT event_id, CASE WHEN e = 0 THEN 0 ELSE 1 END AS replayed FROM (SELECT event_id, event_id % 2 AS e FROM events)""")
def replay_is_idempotent(spark, d):
    """The second append of a batch adds what the first one left out: nothing of the even half is new."""
    e = table(spark, d, "events").select("event_id")
    new = ledger.to_append(e.where("event_id % 2 = 0"), e, ["event_id"], ["event_id"]).select("event_id", F.lit(1).alias("replayed"))
    return e.join(new, "event_id", "left").select("event_id", F.coalesce("replayed", F.lit(0)).alias("replayed"))


@query("""SELECT count(*) AS n FROM (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size > 10 EXCEPT SELECT p_brand, p_size FROM part WHERE p_retailprice > 1500)""")
def missing_outcomes(spark, d):
    p = table(spark, d, "part")
    return p.where("p_size > 10").select("p_brand", "p_size").subtract(p.where("p_retailprice > 1500").select("p_brand", "p_size")).agg(F.count("*").alias("n"))


@query(f"""WITH {OBS_SQL}, b AS (SELECT user_id, event_type, max({{'a': effective_at, 'b': observed_at, 'c': event_id}}) AS v FROM obs WHERE effective_at < {T} AND observed_at <= {T} GROUP BY ALL) SELECT user_id, event_type, v.a AS effective_at, v.b AS observed_at, v.c AS event_id FROM b""")
def future_invariance(spark, d):
    """Facts observed after the cutoff are added to all; the answer must be the one without them."""
    o = observations(spark, d).select("event_id", "user_id", "event_type", "value", "effective_at", "observed_at")
    late = o.withColumns({"event_id": F.col("event_id") + 10**9, "value": F.col("value") + 1, "observed_at": F.greatest(F.col("observed_at"), cutoff()) + F.expr("INTERVAL 1 SECOND")})
    ask = lambda df: asof.latest_as_of(df, ["user_id", "event_type"], ["effective_at", "observed_at", "event_id"], cutoff())
    return ask(o.unionByName(late)).select("user_id", "event_type", "effective_at", "observed_at", "event_id")


@query("""WITH t AS (SELECT l_suppkey AS s, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY 1) SELECT s, round(a / nullif(a + b, 0), 9) AS p FROM t""")
def conditional_decisive(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("b"))
    return g.select("s", r(F.col("a") / F.nullif(F.col("a") + F.col("b"), F.lit(0)), 9).alias("p"))


@query(None)
def prior_calibration(spark, d):
    """Walk-forward: the calibrator of each five days is fitted to the predictions of the days before alone. Equal (logit, y) are counted first, so a fit gets a row for each distinct prediction and result."""
    s = _scored(spark, d).select(F.floor(F.dayofyear("ts") / 5).alias("own"), odds.logit(F.col("p"), 0.005).alias("logit"), "y")
    counts = s.groupBy("own", "logit", "y").agg(F.count("*").alias("n"))
    last = s.agg(F.max("own")).first()[0] or 0
    later = counts.where(F.col("own") < last).select("logit", "y", "n", F.explode(F.sequence(F.col("own") + 1, F.lit(last))).alias("fold"))
    train = later.join(s.select(F.col("own").alias("fold")).distinct(), "fold", "left_semi").groupBy("fold", "logit", "y").agg(F.sum("n").alias("n"))

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        a, b = models.platt(frame["logit"].to_numpy(), frame["y"].to_numpy(), frame["n"].to_numpy())
        return pd.DataFrame({"fold": [key[0]], "slope": [round(a, 6)], "intercept": [round(b, 6)], "n": [int(frame["n"].sum())]})

    return train.groupBy("fold").applyInPandas(run, "fold long, slope double, intercept double, n long")


@query(None)
def bootstrap_refits(spark, d):
    """A refit for each of 30 replicates of 20 resampled blocks, all in one pass with draws as weights; then the interval of a row's logit, and the share of replicates in which it is positive."""
    e = table(spark, d, "embeddings")
    names = [f"x{k}" for k in range(e.select(F.size("embedding")).first()[0])]
    rows = e.select((F.col("vec_id") % 20).cast("int").alias("place"), *[F.get("embedding", k).cast("double").alias(x) for k, x in enumerate(names)], (F.col("label") % 2).cast("int").alias("y"))
    fits = resample.refits(rows, "place", 20, 30, names, "y")
    logit = F.aggregate(F.zip_with("weights", F.array(*map(F.lit, [1.0] * len(names))), lambda w, x: w * x), F.lit(0.0), lambda s, x: s + x)
    values = fits.select(F.round(logit, 6).alias("value"))
    return resample.interval(values, share_positive=F.avg((F.col("value") > 0).cast("double")))


@query("""SELECT count(*) AS violations FROM orders WHERE month(o_orderdate) = 6 OR o_orderdate > TIMESTAMP '2000-01-01'""")
def leakage_gate(spark, d):
    """How many rows may not train the fold of card 6, whose cutoff is the year 2000."""
    train = table(spark, d, "orders").select(F.month("o_orderdate").alias("card"), F.col("o_orderdate").alias("seen"), F.lit(0).alias("fold"))
    test = spark.range(1).select(F.lit(6).alias("card"), F.lit("2000-01-01").cast("timestamp_ntz").alias("cut"), F.lit(0).alias("fold"))
    return resample.leaks(train, test, "card", "seen", "cut").agg(F.count("*").alias("violations"))


@query("""SELECT p_partkey, CAST(floor(date_diff('day', DATE '1980-01-01' + CAST(p_size * 100 AS INT), DATE '2024-01-16')) AS INT) AS days, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END AS southpaw FROM part""")
def physical_features(spark, d):
    born = F.date_add(F.lit("1980-01-01").cast("date"), F.col("p_size") * 100)
    return table(spark, d, "part").select("p_partkey", F.datediff(F.lit("2024-01-16").cast("date"), born).alias("days"), F.when(F.col("p_size") % 2 == 0, 1.0).otherwise(0.0).alias("southpaw"))


@query("""WITH h AS (SELECT CAST(('0x' || substr(md5(concat_ws('|', event_id, user_id, event_type)), 1, 12)) AS BIGINT) AS h FROM events) SELECT count(*) AS n, bit_xor(h) AS x, CAST(sum(h) AS BIGINT) AS s FROM h""")
def data_fingerprint(spark, d):
    """The digest of all rows, equal whatever their order and partitions."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type").repartition(7)
    return ledger.fingerprint(e, e.columns)


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey DESC) rn FROM orders) WHERE rn = 1""")
def dedupe_by_precedence(spark, d):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    o = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return quality.dedupe_by_precedence(o, ["o_custkey", "day"], [rank, F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderpriority")

