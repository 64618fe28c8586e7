"""Queries of batch ingest and the content store: lines as observations that come in three overlapping batches, pages as payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators.ledger import shared_dir
from tidemark.plans.queries import query
from tidemark.plans.tables import table
from tidemark.sources import blobs, ingest


def _lines(spark, d):
    quantity = F.col("l_quantity").cast("long")
    seq = (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 2000 + F.col("l_suppkey")) * 64 + quantity
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("external_id"),
        F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quantity.cast("string"))).alias("payload_hash"),
        F.lit("bout_result").alias("entity_kind"), F.col("l_suppkey").cast("string").alias("subject_id"), F.col("l_linestatus").alias("version_kind"),
        F.when(F.col("l_returnflag") == "A", "summary").when(F.col("l_returnflag") == "N", "partial").otherwise("verified").alias("detail_level"),
        F.col("l_quantity").cast("string").alias("attributes"), F.col("l_shipdate").alias("effective_at"), F.col("l_shipdate").alias("observed_at"), seq.alias("seq"), "l_linenumber",
    )


def _ingested(spark, d):
    store = ingest.Store(spark, f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}", 16)
    lines = _lines(spark, d)
    counts = [store.apply_batch(lines.where(F.col("l_linenumber") <= k).drop("l_linenumber"), f"run-{k}", "crm", "lines", "all", "v1", f"line:{k}") for k in (2, 4, 99)]
    return store, counts


_LINES = """WITH o AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS subject_id, l_linestatus AS version_kind, md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT)) AS payload_hash,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rank, (((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 2000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS seq,
    CASE WHEN l_linenumber <= 2 THEN 1 WHEN l_linenumber <= 4 THEN 2 ELSE 3 END AS batch FROM lineitem
), f AS (
  SELECT *, batch = min(batch) OVER (PARTITION BY subject_id, version_kind) AND seq = min(seq) OVER (PARTITION BY subject_id, version_kind, batch)
    OR rank >= max(rank) OVER (PARTITION BY subject_id, version_kind ORDER BY batch) AS kept FROM o
)"""


@query(_LINES + " SELECT subject_id, version_kind, row_number() OVER (PARTITION BY subject_id, version_kind ORDER BY batch, seq) AS revision, payload_hash FROM f WHERE kept")
def ingested_results(spark, d):
    """Revisions after three batches, each of which also brings again what those before it had."""
    store, _ = _ingested(spark, d)
    return store.results().select("subject_id", "version_kind", "revision", "payload_hash")


@query(_LINES + """, n AS (SELECT batch, count(*) AS inserted, count(*) FILTER (NOT kept) AS skipped_downgrade FROM f GROUP BY 1)
SELECT CAST(batch AS INT) AS batch, inserted, CAST(sum(inserted) OVER (ORDER BY batch) - inserted AS BIGINT) AS skipped_identical, skipped_downgrade, 'line:3' AS token FROM n""".replace("'line:3'", "'line:99'"))
def ingest_counts(spark, d):
    """What each batch did, and the checkpoint that holds at the end."""
    store, counts = _ingested(spark, d)
    rows = spark.createDataFrame([(k + 1, c.inserted, c.skipped_identical, c.skipped_downgrade, "lines") for k, c in enumerate(counts)], "batch int, inserted long, skipped_identical long, skipped_downgrade long, stream string")
    return rows.join(store.checkpoints().select("stream", "token"), "stream").drop("stream")


@query("""WITH p AS (SELECT page_id, html, sha256(html) AS h, sha256(coalesce(url, '')) AS u FROM pages), o AS (
  SELECT CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN u WHEN 2 THEN u ELSE h END AS raw_ref, CASE page_id % 5 WHEN 2 THEN u ELSE h END AS payload_hash FROM p),
s AS (SELECT CASE WHEN raw_ref IS NULL OR raw_ref = '' THEN 'absent' WHEN payload_hash IS NOT NULL AND raw_ref <> payload_hash THEN 'dangling' WHEN raw_ref NOT IN (SELECT h FROM p WHERE h IS NOT NULL) THEN 'missing' ELSE 'present' END AS blob FROM o)
SELECT count(*) FILTER (blob = 'absent') AS n_absent, count(*) FILTER (blob = 'dangling') AS n_dangling, count(*) FILTER (blob = 'missing') AS n_missing, 0::BIGINT AS n_corrupt, count(*) FILTER (blob = 'present') AS n_present,
  count(*) FILTER (blob IN ('dangling', 'missing')) = 0 AS ok, (SELECT count(DISTINCT h) FROM p) AS stored, 0::BIGINT AS stored_again FROM s""")
def blob_integrity(spark, d):
    """Pages put twice into a store of payloads; a fifth each of their references is left out, names another payload, or one that isn't there."""
    p = table(spark, d, "pages")
    root = f"{shared_dir(spark)}/blobs-{uuid.uuid4().hex}"
    body = p.select(F.col("html").cast("binary").alias("payload"))
    first, again = blobs.put(body, root), blobs.put(body, root)
    h, u, k = F.sha2("html", 256), F.sha2(F.coalesce("url", F.lit("")), 256), F.col("page_id") % 5
    refs = p.select(F.when(k.isin(1, 2), u).when(k != 0, h).alias("raw_ref"), F.when(k == 2, u).otherwise(h).alias("payload_hash"))
    return blobs.integrity(refs, blobs.verified(blobs.blobs(spark, root))).withColumns({"stored": F.lit(first).cast("long"), "stored_again": F.lit(again).cast("long")})
