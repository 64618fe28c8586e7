"""Queries of identities: customers are people, suppliers are records that come in, lines of orders are reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import identity
from tidemark.plans.queries import query
from tidemark.plans.tables import table


def _people(spark, d):
    name = F.concat_ws("-", "c_nationkey", F.floor(F.col("c_acctbal") / 500).cast("string"))
    born = F.when(F.col("c_custkey") % 5 != 0, F.date_add(F.lit("1980-01-01").cast("date"), (F.col("c_custkey") % 6).cast("int")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("person"), name.alias("name"), born.alias("born"), "c_mktsegment", F.floor("c_acctbal").cast("string").alias("balance"))


PEOPLE_SQL = """people AS (
  SELECT c_custkey AS person, c_nationkey || '-' || CAST(floor(c_acctbal / 500) AS BIGINT) AS name, CASE WHEN c_custkey % 5 <> 0 THEN DATE '1980-01-01' + CAST(c_custkey % 6 AS INT) END AS born, c_mktsegment, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS balance FROM customer
)"""


@query(f"""WITH {PEOPLE_SQL}, links AS (
  SELECT 'crm' AS source, CAST(person % 200 AS VARCHAR) AS external_id, min(person) AS person FROM people WHERE c_mktsegment = 'BUILDING' GROUP BY 2
  UNION ALL SELECT 'wikidata', balance, person FROM people WHERE c_mktsegment = 'MACHINERY'
), met AS (
  SELECT a.name, b.name AS opponent, year(o_orderdate) * 100 + month(o_orderdate) AS event_id, a.person FROM orders JOIN people a ON a.person = o_custkey JOIN people b ON b.person = o_orderkey % 100 + 1 WHERE a.person <> b.person
  UNION ALL SELECT b.name, a.name, year(o_orderdate) * 100 + month(o_orderdate), b.person FROM orders JOIN people a ON a.person = o_custkey JOIN people b ON b.person = o_orderkey % 100 + 1 WHERE a.person <> b.person
), context AS (SELECT name, opponent, event_id, min(person) AS one, count(DISTINCT person) AS n FROM met GROUP BY ALL),
coming AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS external_id, s_nationkey || '-' || CAST(floor(s_acctbal / 500) AS BIGINT) AS name, CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS wiki,
    CASE WHEN s_suppkey % 4 <> 0 THEN DATE '1980-01-01' + CAST(s_suppkey % 6 AS INT) END AS born, p.name AS opponent, 199500 + s_suppkey % 12 + 1 AS event_id, s_nationkey = 7 AS hinted
  FROM supplier LEFT JOIN people p ON p.person = s_suppkey
), j AS (
  SELECT c.*, k.person AS known, kp.name AS known_name, w.n AS wiki_n, w.one AS wiki_one, coalesce(bn.n, 0) AS born_n, bn.one AS born_one, coalesce(nn.n, 0) AS name_n, coalesce(nn.b, 0) AS any_born, coalesce(x.n, 0) AS context_n, x.one AS context_one
  FROM coming c LEFT JOIN links k ON k.source = 'crm' AND k.external_id = c.external_id LEFT JOIN people kp ON kp.person = k.person
    LEFT JOIN (SELECT external_id, count(DISTINCT person) AS n, min(person) AS one FROM links WHERE source = 'wikidata' GROUP BY 1) w ON w.external_id = c.wiki
    LEFT JOIN (SELECT name, born, count(*) AS n, min(person) AS one FROM people WHERE born IS NOT NULL GROUP BY 1, 2) bn ON bn.name = c.name AND bn.born = c.born
    LEFT JOIN (SELECT name, count(*) AS n, count(born) AS b FROM people GROUP BY 1) nn ON nn.name = c.name
    LEFT JOIN context x ON x.name = c.name AND x.opponent = c.opponent AND x.event_id = c.event_id
), v AS (SELECT *, CASE
    WHEN known IS NOT NULL AND known_name <> name THEN 'duplicate_external_id' WHEN known IS NOT NULL THEN 'exact_source_external_id'
    WHEN wiki_n > 1 THEN 'wikidata_conflict' WHEN wiki_n = 1 AND born_n = 1 AND born_one <> wiki_one THEN 'wikidata_conflicts_with_name_dob' WHEN wiki_n = 1 THEN 'exact_wikidata'
    WHEN hinted THEN 'candidate_hints_forbid_auto_link' WHEN born_n = 1 THEN 'name_dob' WHEN born_n > 1 THEN 'name_dob_not_unique' WHEN born IS NOT NULL AND any_born > 0 THEN 'dob_conflict'
    WHEN context_n > 1 THEN 'context_not_unique' WHEN context_n = 1 THEN 'name_context' WHEN name_n > 0 THEN 'same_normalized_name_without_unique_key' ELSE 'no_existing_person' END AS reason FROM j)
SELECT external_id, reason, CASE WHEN reason IN ('exact_source_external_id', 'exact_wikidata', 'name_dob', 'name_context') THEN 'linked' WHEN reason = 'no_existing_person' THEN 'created' ELSE 'queued' END AS kind,
  CASE reason WHEN 'exact_source_external_id' THEN known WHEN 'exact_wikidata' THEN wiki_one WHEN 'name_dob' THEN born_one WHEN 'name_context' THEN context_one END AS person FROM v""")
def identity_ladder(spark, d):
    people = _people(spark, d)
    crm = people.where("c_mktsegment = 'BUILDING'").groupBy((F.col("person") % 200).cast("string").alias("external_id")).agg(F.min("person").alias("person")).withColumn("source", F.lit("crm"))
    wiki = people.where("c_mktsegment = 'MACHINERY'").select(F.col("balance").alias("external_id"), "person", F.lit("wikidata").alias("source"))
    event = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    bouts = table(spark, d, "orders").select(event.alias("event_id"), F.lit(None).cast("date").alias("event_date"), F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 100 + 1).alias("b"))
    s = table(spark, d, "supplier")
    born = F.when(F.col("s_suppkey") % 4 != 0, F.date_add(F.lit("1980-01-01").cast("date"), (F.col("s_suppkey") % 6).cast("int")))
    coming = s.select(
        F.lit("crm").alias("source"), F.col("s_suppkey").cast("string").alias("external_id"), F.concat_ws("-", "s_nationkey", F.floor(F.col("s_acctbal") / 500).cast("string")).alias("name"), F.floor("s_acctbal").cast("string").alias("wikidata_id"),
        born.alias("born"), (F.lit(199500) + F.col("s_suppkey") % 12 + 1).cast("int").alias("event_id"), F.lit(None).cast("date").alias("event_date"), (F.col("s_nationkey") == 7).alias("hinted"), F.col("s_suppkey").alias("person"),
    )
    coming = coming.join(people.select("person", F.col("name").alias("opponent")), "person", "left").drop("person")
    people = people.select("person", "name", "born")
    return identity.resolve(coming, people, crm.unionByName(wiki), bouts).select("external_id", "reason", "kind", "person")


_RECORDS_SQL = """records AS (
  SELECT 2 * c_custkey AS record, CASE WHEN c_custkey % 3 <> 0 THEN 1900 + c_nationkey END AS born, c_nationkey || ':' || CAST(floor(c_acctbal / 5) AS BIGINT) AS key FROM customer
  UNION ALL SELECT 2 * s_suppkey + 1, 1900 + s_nationkey, s_nationkey || ':' || CAST(floor(s_acctbal / 5) AS BIGINT) FROM supplier
), decisions AS (
  SELECT l_orderkey AS review, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS version,
    CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'R' THEN 'reject' ELSE 'reverse' END AS decision FROM lineitem
)"""


def _reviews(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    decision = F.when(F.col("l_returnflag") == "A", "approve").when(F.col("l_returnflag") == "R", "reject").otherwise("reverse")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("review"), F.row_number().over(w).alias("version"), decision.alias("decision"))


_STATES_SQL = f"""WITH RECURSIVE {_RECORDS_SQL}, walk AS (
  SELECT review, 0::BIGINT AS version, 'pending' AS state, true AS accepted FROM (SELECT DISTINCT review FROM decisions) UNION ALL
  SELECT w.review, d.version, CASE WHEN state = 'pending' AND decision = 'approve' THEN 'approved' WHEN state = 'pending' AND decision = 'reject' THEN 'rejected' WHEN state IN ('approved', 'rejected') AND decision = 'reverse' THEN 'reversed' ELSE state END,
    (state = 'pending' AND decision <> 'reverse') OR (state IN ('approved', 'rejected') AND decision = 'reverse') OR (state = 'approved' AND decision = 'approve') OR (state = 'rejected' AND decision = 'reject') OR (state = 'reversed' AND decision = 'reverse')
  FROM walk w JOIN decisions d ON d.review = w.review AND d.version = w.version + 1
)"""


@query(_STATES_SQL + " SELECT review, version, state, accepted FROM walk WHERE version > 0")
def review_transitions(spark, d):
    return identity.transitions(_reviews(spark, d)).select("review", F.col("version").cast("long").alias("version"), "state", "accepted")


@query(_STATES_SQL + """, last AS (SELECT review, max_by(state, version) AS state FROM walk GROUP BY 1),
pairs AS (
  SELECT 2 * o_custkey AS a, 2 * (l_suppkey + 0) + 1 AS b, state FROM last JOIN orders ON o_orderkey = review JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) < 8) ON l_orderkey = review
), edges AS (
  SELECT x.record AS a, y.record AS b FROM records x JOIN records y USING (key) WHERE x.record <> y.record UNION
  SELECT a, b FROM pairs WHERE state = 'approved' UNION SELECT b, a FROM pairs WHERE state = 'approved'
), reach AS (SELECT record, record AS other FROM records UNION SELECT r.record, e.b FROM reach r JOIN edges e ON e.a = r.other),
of AS (SELECT record, min(other) AS component, count(*) AS size FROM reach GROUP BY 1),
aged AS (SELECT component, min(born) <> max(born) AS aged FROM of JOIN records USING (record) GROUP BY 1),
torn AS (SELECT DISTINCT x.component FROM pairs p JOIN of x ON x.record = p.a JOIN of y ON y.record = p.b AND x.component = y.component WHERE state = 'rejected'),
v AS (SELECT record, component, CASE WHEN size = 1 THEN 'single' WHEN t.component IS NOT NULL OR aged THEN 'conflict' ELSE 'merged' END AS state, CASE WHEN t.component IS NOT NULL THEN 'must_not_be_one' WHEN aged THEN 'dob_conflict' END AS why
  FROM of JOIN aged USING (component) LEFT JOIN torn t USING (component))
SELECT record, component, state, CASE WHEN state = 'merged' THEN component ELSE record END AS identity, CASE WHEN state = 'conflict' THEN why END AS reason FROM v""")
def identity_components(spark, d):
    """Customers and suppliers that share a key or an approved review are one, unless a rejected review or their birth years forbid it."""
    c = table(spark, d, "customer").select((2 * F.col("c_custkey")).alias("record"), F.when(F.col("c_custkey") % 3 != 0, 1900 + F.col("c_nationkey")).alias("born"), F.concat_ws(":", "c_nationkey", F.floor(F.col("c_acctbal") / 5).cast("string")).alias("key"))
    s = table(spark, d, "supplier").select((2 * F.col("s_suppkey") + 1).alias("record"), (1900 + F.col("s_nationkey")).alias("born"), F.concat_ws(":", "s_nationkey", F.floor(F.col("s_acctbal") / 5).cast("string")).alias("key"))
    records = c.unionByName(s)
    small = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("review")).agg(F.min("l_suppkey").alias("supplier"), F.sum("l_quantity").alias("q")).where("q < 8")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("review"), (2 * F.col("o_custkey")).alias("a"))
    pairs = identity.in_force(_reviews(spark, d)).join(small, "review").join(orders, "review").select("a", (2 * F.col("supplier") + 1).alias("b"), "state")
    return identity.identities(records.select("record", "born"), records.select("record", "key"), pairs.where("state = 'approved'").select("a", "b"), pairs.where("state = 'rejected'").select("a", "b"))
