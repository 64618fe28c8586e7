"""Releases of documents: canonical pages by content, a tree of digests over them, and one step that makes a release current.

A document is the rows of a key, cut into pages by the hash of each row's own key: as many hex digits of it as keep a
page near `size` rows. So a new row changes one page, however large its document, and no task holds a document. A page's
body is the same bytes whatever the partitions. Pages are stored once under their digests (`blobs`); a release is a list
of them that one renamed manifest makes current, so one that is refused or stops leaves the release before it in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tidemark.operators.ledger import PACKED, dropped, stored, sweeping
from tidemark.sources import blobs
from tidemark.sources.ingest import Store, bucket_of

#: The most hex digits that a page is named by.
DEEPEST = 10
PAGE = "doc string, page string, n long, digest string"


class Refused(ValueError):
    """A row that must not be published, or a release without rows."""


def canonical(value: Column, kind: DataType) -> Column:
    """The value with the fields of its structs in the order of their names, at every depth."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[canonical(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: canonical(v, kind.elementType))
    return value


def pages_of(rows: DataFrame, doc: str, key: Sequence[str], fields: Sequence[str], size: int = 1000) -> DataFrame:
    """doc, page, n, body, digest: canonical JSON with doc, page and its items, sorted by key and then content; nulls are written.

    Rows with a null doc belong to no document and are left out. Repeated rows are items each; rows of one key share a
    page, so a page is longer than `size` only by chance or by repeats of a key.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    item = F.struct(*[canonical(F.col(c), kinds[c]).alias(c) for c in sorted(fields)])
    there = rows.where(F.col(doc).isNotNull()).select(F.col(doc).cast("string").alias("doc"), F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)]).alias("k"), item.alias("item"), F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in key]), 256), 1, DEEPEST).alias("h"))
    n = F.col("rows")
    depth = sum(((n > size * 16**k).cast("int") for k in range(DEEPEST)), F.lit(0))
    depths = there.groupBy("doc").agg(F.count("*").alias("rows")).select("doc", depth.alias("depth"))
    placed = there.join(depths, "doc").select("doc", F.expr("substring(h, 1, depth)").alias("page"), F.struct("k", "item").alias("v"))
    made = placed.groupBy("doc", "page").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list("v")), lambda v: v["item"]).alias("items"))
    body = F.to_json(F.struct("doc", "items", "page"), {"ignoreNullFields": "false"})
    return made.select("doc", "page", "n", body.alias("body")).withColumn("digest", F.sha2("body", 256))


def document_digests(pages: DataFrame) -> DataFrame:
    """doc, n, digest: a node is the digest of its children's digests in order; 16 children at most, so one level a step."""
    nodes = pages.select("doc", "page", "n", "digest")
    deepest = nodes.agg(F.max(F.length("page"))).first()[0] or 0
    for level in range(deepest, 0, -1):
        up = nodes.where(F.length("page") == level).groupBy("doc", F.expr(f"substring(page, 1, {level - 1})").alias("page"))
        folded = up.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "digest"))), lambda c: c["digest"]), ""), 256).alias("digest"))
        nodes = nodes.where(F.length("page") < level).unionByName(folded)
    return nodes.select("doc", "n", "digest")


def root_digest(documents: DataFrame, digits: int = 3) -> str:
    """One digest of all documents: by the first hex digits of their names' hashes, then of those (16 ** digits rows at most)."""
    name = F.sha2("doc", 256)
    parts = documents.groupBy(F.substring(name, 1, digits).alias("part")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name.alias("h"), "digest"))), lambda d: F.concat(d["h"], d["digest"])), ""), 256).alias("digest"))
    top = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda p: F.concat(p["part"], p["digest"])), ""), 256))
    return top.first()[0]


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc, page, state: added, changed, same or removed."""
    a, b = before.select("doc", "page", F.col("digest").alias("a")), after.select("doc", "page", F.col("digest").alias("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, ["doc", "page"], "full").select("doc", "page", state.alias("state"))


class Releases(Store):
    """`payloads` holds pages by content, `pages` the lists of releases; the last manifest is the current release."""

    tables = ("pages",)

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        super().__init__(spark, root, buckets)

    def current(self) -> tuple[str, str] | None:
        """Name and root digest of the current release."""
        last = self.manifests().agg(F.max_by(F.struct("run", "token"), "number")).first()[0]
        return last and (last.run, last.token)

    def pages(self, release: str | None = None) -> DataFrame:
        """doc, page, n, digest of a release; of the current one if none is named."""
        own = self.manifests() if release is None else self.manifests().where(F.col("run") == release)
        batch = own.agg(F.max_by("batch", "number")).first()[0]
        return self._table("pages", PAGE).where(F.col("batch") == F.lit(batch)).drop("batch", "bucket")

    def bodies(self, release: str | None = None) -> DataFrame:
        """doc, page, body."""
        return self.pages(release).join(blobs.blobs(self.spark, f"{self.root}/payloads"), "digest").select("doc", "page", F.col("payload").cast("string").alias("body"))

    @sweeping
    def publish(self, release: str, rows: DataFrame, doc: str, key: Sequence[str], fields: Sequence[str], size: int = 1000, refuse: Mapping[str, Column] | None = None, between: Callable[[str], None] = lambda step: None) -> int:
        """Makes a release current; gives how many pages had to be written. A row for which a test of `refuse` holds stops it before anything is written, as do no rows."""
        tests = {n: F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in (refuse or {}).items()}
        found = rows.agg(F.count("*").alias("__n"), *tests.values()).first()
        bad = [n for n in tests if found[n]]
        if bad or not found["__n"]:
            raise Refused(f"{release}: {', '.join(bad) or 'no rows'}")
        numbers = self._numbers()
        number = (numbers[-1] if numbers else 0) + 1
        made = stored(pages_of(rows, doc, key, fields, size), "release-pages")
        written = blobs.put(made.select(F.col("body").alias("payload")), f"{self.root}/payloads")
        between("payloads")
        batch = uuid.uuid4().hex
        made.select("doc", "page", "n", "digest", bucket_of(self.buckets, "doc", "page").alias("bucket")).repartition("bucket").write.options(**PACKED).partitionBy("bucket").parquet(f"{self.root}/pages/batch={batch}")
        between("pages")
        root = root_digest(document_digests(made))
        dropped(made)
        self._publish(number, {"number": number, "batch": batch, "run": release, "source": "release", "stream": "release", "scope": "all", "version": "v1", "token": root})
        return written
