"""Benchmark decontamination by spaced seeds that no allowed substitutions can all break.

A seed looks at the words in the fixed places of a mask and ignores those between. In a window of which a share must
agree only so many words can be changed; the masks of its length are a family such that, wherever these changes lie, one
of the masks fits somewhere in the window with all its fixed places unchanged (shown by going through all patterns).
Hashed seeds of all documents meet those of the benchmark; each hit fixes how a document and an item lie against each
other, and around it the whole words are compared, so that a passage counts although some words were changed. All of it
is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, text_of


#: Places that are compared in one row, on average: a long text with many hits gets several rows.
HITS = 256


#: By (words, changed words) a family of masks, of which one survives every pattern of changes in such a window.
FAMILIES = {
    (5, 1): ((0, 1, 3), (0, 2, 3)),
    (10, 2): ((0, 1, 2, 4), (0, 1, 3, 6)),
    (15, 3): ((0, 1, 2, 4, 5), (0, 1, 2, 3, 7)),
    (20, 4): ((0, 1, 2, 4, 5), (0, 1, 2, 3, 5)),
}
#: Buckets of the bitmap of seeds, of 32,768 bits each, at most.
BUCKETS = 4096


def masks_for(n: int, window: int, share: float) -> tuple[tuple[int, ...], ...]:
    """Masks (fixed places, from 0) for windows of an item of n words that agree in `share` of their places.

    A family for fewer words and as many changes serves too. Without a family the window is cut into equal blocks, one of
    which has its part of the changes at most; a block without changes has one mask, of its own length, six at most. Only
    windows of one or two words, and blocks as short, have no place to ignore.
    """
    wide = min(n, window)
    changed = wide - next(k for k in range(wide + 1) if k >= share * wide)
    for blocks in range(1, changed + 2):
        words, left = wide // blocks, changed // blocks
        if not left:
            return (tuple(range(words)),) if words < 3 else (tuple(k for k in range(min(words, 6)) if k != min(words, 6) - 2),)
        if found := max((k for k in FAMILIES if k[1] == left and k[0] <= words), default=None):
            return FAMILIES[found]
    raise AssertionError("a block for each change and one more has one without changes")


def words_of_text(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(text_of(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds_of(words: Column, masks: Sequence[tuple[int, ...]]) -> Column:
    """Array of (pos, seed) of each of these masks at every place where it fits. Words are hashed once."""

    def of_mask(hashed: Column, mask: tuple[int, ...]) -> Column:
        places = F.when(F.size(hashed) > mask[-1], F.sequence(F.lit(0), F.size(hashed) - mask[-1] - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(sum(1 << k for k in mask)), *[F.get(hashed, i + k) for k in mask]).alias("seed")))

    return F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda hashed: F.concat(*[of_mask(hashed, m) for m in masks])), 0)


def _may_hit(windows: DataFrame, seeds: DataFrame, count: int) -> DataFrame:
    """windows without most of those whose seed is no seed of the benchmark: a bitmap of hashed seeds, BUCKETS * 4 KB at most, is broadcast."""
    buckets = max(1, min(BUCKETS, count * 16 // 32768))
    place = F.pmod(F.col("seed"), F.lit(buckets * 32768))
    bucket, bit = F.floor(place / 32768).cast("int"), F.pmod(place, F.lit(32768)).cast("int")
    maps = materialise(seeds.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "seed-bits", lasting=True)
    met = windows.withColumns({"bucket": bucket, "bit": bit}).join(F.broadcast(maps), "bucket")
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, F.pmod("bit", F.lit(8)).cast("int")) == 1).drop("bucket", "bit", "bits")


def find_leaks(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = 20, share: float = 0.8, broadcast_seeds: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, matched, compared): pairs of which some `window` words in a row (all of a shorter item) agree in `share` of the places.

    matched and compared are those of the best such stretch. No such pair is lost, wherever the changed words lie. Share
    is over 0 and at most 1. Null and empty texts hold nothing and leak nothing; rows with a
    null id are left out; repeated rows and ties give one pair, with the largest matched; empty tables give no pairs;
    other columns don't matter. The benchmark's seeds are broadcast only after they were counted and are at most
    `broadcast_seeds` (16 bytes each); beyond, they are joined by a shuffle, which only windows enter that a bitmap of the
    seeds lets pass. An item of one or two words is an exact seed of its own: every text with them leaks it, so such items
    don't belong in a benchmark. Long texts are searched whole, those with many hits in several rows. Documents are verified in a second pass
    that only those with hits enter.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be over 0 and at most 1")
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), words_of_text(F.col(text)).alias("iw")).where(F.size("iw") > 0)
    items = materialise(items, "items", lasting=True)
    wide = F.least(F.lit(window), F.size("iw"))
    widths = [r.n for r in items.select(wide.alias("n")).distinct().collect()]  # at most `window` values
    masks = sorted({m for n in widths for m in masks_for(n, window, share)} or {(0,)})
    parts = [items.where(wide.isin([n for n in widths if m in masks_for(n, window, share)])).select("item", F.size("iw").alias("len"), F.inline(seeds_of(F.col("iw"), [m]))) for m in masks]
    seeds = parts[0]
    for part in parts[1:]:
        seeds = seeds.unionByName(part)
    seeds = materialise(seeds.withColumnRenamed("pos", "at"), "seeds", lasting=True)
    count = seeds.count()
    small = count <= broadcast_seeds

    docs = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("__text"))
    windows = docs.select("doc", words_of_text(F.col("__text")).alias("w")).select("doc", F.inline(seeds_of(F.col("w"), masks)))
    if not small:
        windows = _may_hit(windows, seeds, count)
    hits = windows.join(F.broadcast(seeds) if small else seeds, "seed").select("doc", "item", "len", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
    hits = materialise(hits, "hits", lasting=True)
    parts = hits.groupBy("doc").agg(F.ceil(F.count("*") / HITS).cast("int").alias("parts"))
    hits = hits.join(materialise(parts, "hit-parts", lasting=True), "doc").groupBy("doc", F.pmod(F.xxhash64("item", "diagonal"), "parts").alias("part")).agg(F.collect_list(F.struct("item", "len", "diagonal")).alias("hits"))
    hits = materialise(hits.drop("part"), "hit-groups", lasting=True)

    held = docs.join(hits, "doc").select("doc", "hits", words_of_text(F.col("__text")).alias("w"))
    first = lambda h: F.greatest(h["diagonal"], F.lit(0))
    lie = F.transform("hits", lambda h: F.struct(h["item"].alias("item"), (first(h) - h["diagonal"]).alias("skip"), F.slice(F.col("w"), first(h) + 1, F.least(h["len"], h["len"] + h["diagonal"])).alias("dw")))
    laid = held.select("doc", F.inline(lie)).join(items, "item")
    same = F.zip_with("dw", F.slice("iw", F.col("skip") + 1, F.size("dw")), lambda a, b: a.eqNullSafe(b).cast("int"))
    laid = laid.select("doc", "item", same.alias("e"), wide.alias("wide"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    starts = F.when(F.size("e") >= F.col("wide"), F.sequence(F.lit(1), F.size("e") - F.col("wide") + 1)).otherwise(F.array().cast("array<int>"))
    best = F.coalesce(F.array_max(F.transform(starts, lambda k: total(F.slice(F.col("e"), k, F.col("wide"))))), F.lit(0))
    laid = laid.select("doc", "item", best.alias("matched"), F.col("wide").alias("compared")).where(F.col("matched") >= share * F.col("compared"))
    out = laid.groupBy("doc", "item").agg(F.max(F.struct("matched", "compared")).alias("m"))
    return out.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("m.matched").cast("long").alias("matched"), F.col("m.compared").cast("long").alias("compared"))


def without_leaks(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **kw) -> DataFrame:
    """documents without those that leak; rows with a null doc_id aren't judged and stay."""
    leaks = materialise(find_leaks(documents, benchmark, doc_id, **kw).select(F.col(doc_id).alias("leak")).distinct(), "leaks", lasting=True)
    return documents.join(leaks, documents[doc_id] == leaks["leak"], "left_anti")
