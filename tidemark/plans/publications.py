"""Queries of releases: lines as items of their suppliers' documents, published, corrected and published again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators.ledger import shared_dir
from tidemark.plans.queries import query
from tidemark.plans.tables import table
from tidemark.sources import releases

KEY, FIELDS, SIZE = ("l_orderkey", "l_linenumber", "l_partkey"), ("l_returnflag", "l_partkey", "l_orderkey", "l_linenumber"), 16


def items(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", *FIELDS)


def _pages_sql(name: str, rows: str) -> str:
    return f"""{name}_i AS (SELECT CAST(l_suppkey AS VARCHAR) AS doc, l_orderkey, l_linenumber, l_partkey, l_returnflag, sha256(l_orderkey || chr(31) || l_linenumber || chr(31) || l_partkey) AS h FROM {rows}),
{name}_n AS (SELECT doc, (count(*) > {SIZE})::INT + (count(*) > {SIZE * 16})::INT + (count(*) > {SIZE * 256})::INT + (count(*) > {SIZE * 4096})::INT AS depth FROM {name}_i GROUP BY 1),
{name}_p AS (SELECT doc, substr(h, 1, depth) AS page, count(*) AS n, string_agg('{{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || ',"l_returnflag":"' || l_returnflag || '"}}', ',' ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) AS items FROM {name}_i JOIN {name}_n USING (doc) GROUP BY 1, 2),
{name} AS (SELECT doc, page, n, sha256('{{"doc":"' || doc || '","items":[' || items || '],"page":"' || page || '"}}') AS digest FROM {name}_p)"""


@query(f"WITH {_pages_sql('a', 'lineitem')} SELECT doc, page, n, digest FROM a")
def release_pages(spark, d):
    return releases.pages_of(items(spark, d), "l_suppkey", KEY, FIELDS, SIZE).select("doc", "page", "n", "digest")


_FOLD = "f{0} AS (SELECT doc, substr(page, 1, greatest(length(page) - 1, 0)) AS page, sum(n) AS n, CASE WHEN max(length(page)) = 0 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY page)) END AS digest FROM {1} GROUP BY 1, 2)"


@query(f"WITH {_pages_sql('a', 'lineitem')}, {_FOLD.format(1, 'a')}, {_FOLD.format(2, 'f1')}, {_FOLD.format(3, 'f2')}, {_FOLD.format(4, 'f3')} SELECT doc, CAST(n AS BIGINT) AS n, digest FROM f4")
def release_digests(spark, d):
    return releases.document_digests(releases.pages_of(items(spark, d), "l_suppkey", KEY, FIELDS, SIZE))


@query(f"""WITH one AS (SELECT * FROM lineitem WHERE l_orderkey % 50 > 0), two AS (SELECT * REPLACE (CASE WHEN l_orderkey % 97 = 0 THEN 'Z' ELSE l_returnflag END AS l_returnflag) FROM lineitem WHERE l_orderkey % 53 > 0),
{_pages_sql('a', 'one')}, {_pages_sql('b', 'two')} SELECT doc, page, CASE WHEN a.doc IS NULL THEN 'added' WHEN b.doc IS NULL THEN 'removed' WHEN a.digest = b.digest THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b USING (doc, page)""")
def release_changes(spark, d):
    """Two releases in a store; what the second adds, changes and leaves out."""
    store = releases.Releases(spark, f"{shared_dir(spark)}/site-{uuid.uuid4().hex}", 8)
    i, k = items(spark, d), F.col("l_orderkey")
    for name, rows in (("one", i.where(k % 50 > 0)), ("two", i.where(k % 53 > 0).withColumn("l_returnflag", F.when(k % 97 == 0, "Z").otherwise(F.col("l_returnflag"))))):
        store.publish(name, rows, "l_suppkey", KEY, FIELDS, SIZE, {"no order": k.isNull()})
    return releases.changes(store.pages("one"), store.pages())
