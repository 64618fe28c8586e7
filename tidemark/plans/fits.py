"""Queries of the fits by sums and of ratings by period, and the SQL for those that SQL can unroll."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import markets, newton, ratings
from tidemark.plans.queries import query, r
from tidemark.plans.tables import table

STEPS = 12
_STEP = """w{k} AS MATERIALIZED (
  SELECT g, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS a, b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b FROM (
    SELECT g, a, b, 2 * sum(z1 * (p - y)) + a AS g1, 2 * sum(z2 * (p - y)) + b AS g2,
      2 * sum(z1 * z1 * p * (1 - p)) + 1 AS h11, 2 * sum(z1 * z2 * p * (1 - p)) AS h12, 2 * sum(z2 * z2 * p * (1 - p)) + 1 AS h22
    FROM (SELECT *, 1 / (1 + exp(-(a * z1 + b * z2))) AS p FROM z JOIN w{before} USING (g)) GROUP BY g, a, b)
)"""
_NEWTON = ", ".join(_STEP.format(k=k, before=k - 1) for k in range(1, STEPS + 1))


@query(f"""WITH lines AS (SELECT l_quantity - 25 AS x1, l_discount - l_tax AS x2, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS y, year(l_shipdate) AS yr FROM lineitem),
rows AS (SELECT g, x1, x2, y FROM lines, range(4) t(g) WHERE yr < 1996 + g),
s AS (SELECT g, sqrt(avg(x1 * x1)) AS s1, sqrt(avg(x2 * x2)) AS s2, count(*) AS n FROM rows GROUP BY g),
z AS MATERIALIZED (SELECT g, x1 / s1 AS z1, x2 / s2 AS z2, y FROM rows JOIN s USING (g)),
w0 AS (SELECT g, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM s), {_NEWTON}
SELECT CAST(g AS INT) AS fold, n, round(a / s1, 8) AS quantity, round(b / s2, 8) AS margin FROM w{STEPS} JOIN s USING (g)""")
def walk_forward_ridge(spark, d):
    """Fold g trains on all lines shipped before 1996 + g: overlapping folds, one aggregation a step for all of them."""
    x = table(spark, d, "lineitem").select((F.col("l_quantity") - 25).alias("x1"), (F.col("l_discount") - F.col("l_tax")).alias("x2"), (F.col("l_returnflag") == "A").cast("int").alias("y"), F.year("l_shipdate").alias("yr"))
    theta, n = newton.fit_ridge(x, ["x1", "x2"], "y", newton.earlier_weights("yr", 1996, 4), 4)
    fits = spark.createDataFrame([(g, int(n[g]), float(theta[g, 0]), float(theta[g, 1])) for g in range(4)], "fold int, n long, quantity double, margin double")
    return fits.select("fold", "n", r("quantity", 8).alias("quantity"), r("margin", 8).alias("margin"))


CORNERS = newton.Corners(shared=("size",), paired=(("quantity_a", "quantity_b"),), differences=("margin",))


def contests(spark, d):
    """lineitem as contests of its supplier and the part's maker: an end in one of three rounds by one of six causes, or the distance."""
    part = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("size"), (F.col("p_retailprice") / 50).alias("quantity_b"))
    line = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    cause = F.when(F.col("l_returnflag") == "N", 0).otherwise(1 + (F.col("l_quantity") + F.col("l_linenumber") + F.col("l_suppkey")).cast("int") % 6)
    return line.select("size", F.col("l_quantity").alias("quantity_a"), "quantity_b", (F.col("l_discount") - F.col("l_tax")).alias("margin"), cause.alias("cause"), F.when(cause == 0, 2).otherwise(F.col("l_partkey") % 3).cast("int").alias("last"), F.year("l_shipdate").alias("yr"))


@query(None)
def tied_hazards(spark, d):
    """Tied competing risks over person periods, four walk-forward folds at once."""
    c = contests(spark, d)
    periods = markets.person_periods(c.withColumn("name", F.col("cause").cast("string")), F.col("last"), F.col("name")).withColumn("label", F.when(F.col("class") == "continue", 0).otherwise(F.col("class").cast("int")))
    fit = newton.fit_tied(periods.select(*CORNERS.names, "interval", "label", "yr"), CORNERS, "label", newton.earlier_weights("yr", 1996, 4), 4, 3, interval="interval", intervals=3)
    rows = [(g, k, [float(x) for x in fit.theta[g, k]]) for g in range(4) for k in range(3)]
    return spark.createDataFrame(rows, "fold int, pair int, theta array<double>").select("fold", "pair", F.transform("theta", lambda x: F.round(x, 6) + F.lit(0.0)).alias("theta"))


@query(None)
def tied_decisions(spark, d):
    """Decisions of the contests that went the distance, with the chances of every year's mean contest."""
    c = contests(spark, d).where("cause = 0").withColumn("label", (F.col("quantity_a") + F.col("last")).cast("int") % 3)
    fit = newton.fit_tied(c.select(*CORNERS.names, "label", "yr"), CORNERS, "label", newton.earlier_weights("yr", 3000, 1), 1, 1)
    mean = c.groupBy("yr").agg(*[F.avg(n).alias(n) for n in CORNERS.names])
    p = fit.probabilities(0)
    return mean.select("yr", *[r(p[k]).alias(n) for k, n in enumerate(("draw", "a", "b"))])




def games(spark, d):
    """The first two lines of an order as a game of their suppliers, its year as the period."""
    l = table(spark, d, "lineitem")
    a = l.where("l_linenumber = 1").select("l_orderkey", F.col("l_suppkey").alias("a"), F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.5).otherwise(0.0).alias("score"))
    b = l.where("l_linenumber = 2").select("l_orderkey", F.col("l_suppkey").alias("b"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("period"))
    return a.join(b, "l_orderkey").join(o, "l_orderkey").select("period", "a", "b", "score")


_RATED = """p{k} AS MATERIALIZED (SELECT * FROM sides WHERE period = {year}),
u{k} AS MATERIALIZED (
  SELECT player, r0, d0, n0, w0, r0 + ln(10) / 400 * d1 * d1 * step AS r1, d1, n0 + n AS n1, w0 + w AS w1 FROM (
    SELECT player, r0, d0, n0, w0, greatest(50.0, sqrt(1 / (1 / (d0 * d0) + pow(ln(10) / 400, 2) * sum(g * g * e * (1 - e))))) AS d1, sum(g * (score - e)) AS step, count(*) AS n, count(*) FILTER (score <> 0.5) AS w
    FROM (SELECT *, 1 / (1 + pow(10, -g * (r0 - ro) / 400)) AS e FROM (
      SELECT p.player, score, coalesce(s.r, 1500.0) AS r0, coalesce(s.d, 350.0) AS d0, coalesce(s.n, 0) AS n0, coalesce(s.w, 0) AS w0, coalesce(o.r, 1500.0) AS ro,
        1 / sqrt(1 + 3 * pow(ln(10) / 400 * coalesce(o.d, 350.0) / pi(), 2)) AS g
      FROM p{k} p LEFT JOIN s{before} s ON s.player = p.player LEFT JOIN s{before} o ON o.player = p.other)) GROUP BY player, r0, d0, n0, w0)
), s{k} AS MATERIALIZED (SELECT player, r1 AS r, d1 AS d, n1 AS n, w1 AS w FROM u{k} UNION ALL SELECT * FROM s{before} WHERE player NOT IN (SELECT player FROM u{k}))"""
YEARS = range(1995, 2003)
RATED = """WITH games AS (
  SELECT a.l_suppkey AS a, b.l_suppkey AS b, CASE a.l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'N' THEN 0.5 ELSE 0.0 END AS score, year(o_orderdate) AS period
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_suppkey <> b.l_suppkey JOIN orders ON o_orderkey = a.l_orderkey
), sides AS (SELECT period, a AS player, b AS other, score FROM games UNION ALL SELECT period, b, a, 1 - score FROM games),
s0 AS (SELECT NULL::BIGINT AS player, 0.0::DOUBLE AS r, 0.0::DOUBLE AS d, 0::BIGINT AS n, 0::BIGINT AS w WHERE false), """ + ", ".join(_RATED.format(k=k, before=k - 1, year=y) for k, y in enumerate(YEARS, 1))


@query(RATED + f" SELECT player, round(r, 6) AS rating, round(d, 6) AS deviation, n AS games FROM s{len(YEARS)}")
def sequential_ratings(spark, d):
    """Ratings after all periods."""
    _, state = ratings.rate(games(spark, d))
    return state.select("player", r("rating").alias("rating"), r("deviation").alias("deviation"), "games")


@query(RATED + " " + " UNION ALL ".join(f"SELECT {y} AS period, player, round(r0, 6) AS rating, round(d0, 6) AS deviation, n0 AS games, w0 AS decisive, w0 = 0 AS missing FROM u{k}" for k, y in enumerate(YEARS, 1)))
def ratings_before_cards(spark, d):
    """What each player of a period held before it."""
    before, _ = ratings.rate(games(spark, d))
    return before.select("period", "player", r("before_rating").alias("rating"), r("before_deviation").alias("deviation"), F.col("before_games").alias("games"), F.col("before_decisive").alias("decisive"), (F.col("before_decisive") == 0).alias("missing"))
