"""Queries of walk-forward backtests: lines as contests, their shipping months as cards, results seen a day later and corrected after 200 days."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import scores, walkforward
from tidemark.operators.ledger import shared_dir
from tidemark.plans.queries import query, r
from tidemark.plans.tables import table
from tidemark.sources.backtests import Backtest

MODEL = walkforward.Model(("quantity", "margin"))
UNTIL = tuple(datetime(year, 1, 1) for year in (1997, 1999, 2100))


def _lines(spark, d):
    """Lines of 1998 are held out, those numbered 7 lack a feature; some first results are draws."""
    line, up = table(spark, d, "lineitem"), F.col("l_quantity") + F.col("l_suppkey") % 20 > 30
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")).alias("contest"), F.date_format("l_shipdate", "yyyy-MM").alias("card"),
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("cutoff"), (F.year("l_shipdate") == 1998).alias("holdout"), (F.col("l_quantity") - 25).alias("quantity"),
        F.when(F.col("l_linenumber") < 7, F.col("l_discount") - F.col("l_tax")).alias("margin"), F.col("l_shipdate").alias("shipped"), F.when(F.col("l_suppkey") % 9 > 0, up.cast("int")).alias("y"), (F.col("l_orderkey") % 3 == 0).alias("corrected"),
    )


def _tables(spark, d):
    lines = _lines(spark, d)
    night = lines.select("contest", F.lit(1).alias("rank"), (F.col("shipped") + F.expr("INTERVAL 1 DAY")).alias("seen"), "y")
    later = lines.where("corrected").select("contest", F.lit(2).alias("rank"), (F.col("shipped") + F.expr("INTERVAL 200 DAYS")).alias("seen"), F.coalesce(1 - F.col("y"), F.lit(1)).alias("y"))
    return lines.select("contest", "card", "holdout", "quantity", "margin"), lines.select("card", "cutoff").distinct(), night.unionByName(later)


_WALK = """WITH c AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) AS contest, strftime(l_shipdate, '%Y-%m') AS card, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS cutoff,
    year(l_shipdate) = 1998 AS holdout, CAST(round((l_quantity - 25) * 100) AS BIGINT) AS x1, CASE WHEN l_linenumber < 7 THEN CAST(round((l_discount - l_tax) * 100) AS BIGINT) END AS x2,
    CASE WHEN l_suppkey % 9 > 0 THEN CASE WHEN l_quantity + l_suppkey % 20 > 30 THEN 1 ELSE 0 END END AS y1, l_shipdate + INTERVAL 1 DAY AS seen1, CASE WHEN l_orderkey % 3 = 0 THEN l_shipdate + INTERVAL 200 DAY END AS seen2
  FROM lineitem
), k AS (SELECT DISTINCT cutoff FROM c), t AS (SELECT *, coalesce(1 - y1, 1) AS y2 FROM c WHERE NOT holdout AND x2 IS NOT NULL),
m AS (SELECT cutoff, count(*) AS n, sum(x1 * (2 * y - 1)) AS b1, sum(x2 * (2 * y - 1)) AS b2, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22 FROM
  (SELECT k.cutoff, x1, x2, CASE WHEN seen2 <= k.cutoff THEN y2 ELSE y1 END AS y FROM k JOIN t ON t.seen1 <= k.cutoff) WHERE y IS NOT NULL GROUP BY 1),
g AS (SELECT cutoff, n, b1, b2, s12, s11 * (1 + 1.0::DOUBLE / n) AS h11, s22 * (1 + 1.0::DOUBLE / n) AS h22 FROM m),
f AS MATERIALIZED (SELECT cutoff, coalesce(n, 0) AS n_train, coalesce((h22 * b1 - s12 * b2) / (h11 * h22 - s12::DOUBLE * s12), 0) AS w1, coalesce((h11 * b2 - s12 * b1) / (h11 * h22 - s12::DOUBLE * s12), 0) AS w2 FROM k LEFT JOIN g USING (cutoff)),
p AS MATERIALIZED (SELECT *, CASE WHEN raw IS NOT NULL THEN CAST(least(floor(raw * 20), 19) AS INT) END AS bin FROM (SELECT c.*, n_train, w1, w2, CASE WHEN x2 IS NOT NULL THEN least(greatest(0.5 + (w1 * x1 + w2 * x2) / 2, 0.01), 0.99) END AS raw FROM c JOIN f USING (cutoff))),
h AS (SELECT cutoff, bin, count(*) AS n, sum(y) AS won FROM (SELECT k.cutoff, bin, CASE WHEN seen2 <= k.cutoff THEN coalesce(1 - y1, 1) ELSE y1 END AS y FROM k JOIN p ON p.seen1 <= k.cutoff WHERE NOT holdout AND x2 IS NOT NULL) WHERE y IS NOT NULL GROUP BY 1, 2),
q AS (SELECT p.*, (coalesce(won, 0) + 25 * raw) / (coalesce(n, 0) + 25) AS prob FROM p LEFT JOIN h USING (cutoff, bin))"""


@query(_WALK + """ SELECT contest, card, CASE WHEN x2 IS NULL THEN 'no_features' ELSE 'scored' END AS status, n_train, round(w1 * 100, 8) + 0.0 AS quantity, round(w2 * 100, 8) + 0.0 AS margin, bin, round(raw, 6) AS raw, round(prob, 6) AS p FROM q""")
def walk_forward_predictions(spark, d):
    """Every contest as its card's fit had it: running sums here, a fit made anew for each card in SQL."""
    p = walkforward.walk(*_tables(spark, d), MODEL).predictions
    return p.select("contest", "card", "status", "n_train", *[r(F.col("weights")[k], 8).alias(n) for k, n in enumerate(MODEL.features)], "bin", r("raw").alias("raw"), r("p").alias("p"))


@query(_WALK + """ SELECT card, count(*) AS n, any_value(n_train) AS n_train, count(raw) AS scored, round(avg(raw), 6) AS raw, round(avg(prob), 6) AS p, round(avg(CASE WHEN y1 = 1 THEN -ln(prob) WHEN y1 = 0 THEN -ln(1 - prob) END), 6) AS log_loss FROM q GROUP BY 1""")
def walk_forward_advances(spark, d):
    """Three advances, each from the state that the one before left; scored by the first results."""
    test = Backtest(spark, f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}", MODEL, 8)
    contests, cards, versions = _tables(spark, d)
    for until in UNTIL:
        test.advance(contests, cards, versions, until)
    y = _lines(spark, d).select("contest", "y")
    loss = F.avg(F.when(F.col("p").isNotNull(), scores.log_loss(F.col("y"), F.col("p"))))
    g = test.predictions().join(y, "contest").groupBy("card").agg(F.count("*").alias("n"), F.any_value("n_train").alias("n_train"), F.count("raw").alias("scored"), r(F.avg("raw")).alias("raw"), r(F.avg("p")).alias("p"), r(loss).alias("log_loss"))
    return g.select("card", "n", "n_train", "scored", "raw", "p", "log_loss")
