"""Exact n-gram Jaccard join: shared-coordinate blocks, count-vector R-trees, exact verification.

Words are hashed, every run of five is a token, and a text is the set of its tokens. Tokens fall into groups, and a
text's group counts are a point: the overlap of two texts is at most the sum of their coordinates' minima, and for two
boxes of points at most that of their upper corners. That bound prunes an R-tree, but in so many dimensions no tree over
a whole corpus has selective upper levels (each leaf's box meets nearly all others). So the top level fans out by
single coordinates instead (the same bound by minima, with a group for each token). Tokens are ordered by how rare their
bucket is; any two different texts over the threshold share at least `SHARED` tokens within the first
n - ceil(0.75 n) + SHARED of each. Below it:

1. Equal sets are one class. A block is the classes that have a token among their first. It is cut where the sizes,
   in order, jump by more than the threshold allows, as no link spans such a jump. Blocks with one class end here, nearly
   all of them.
2. A block of two is one candidate pair, which needs `SHARED` common tokens or a larger block that holds both. In larger
   blocks, members pair with the block's centre only (a star), so a group of k near copies costs k pairs, not k * k. The
   centre is the member whose rare tokens are the most common, most likely what the others were copied from.
3. Points are made for classes in candidate pairs and blocks only. Each class is checked against the centre that is the
   nearest by the bound: an exact check on the whole texts. Links make components.
4. Members of blocks with one centre are a family, so two members of a block are in one. Families that still hold several
   components search an R-tree of their points for pairs across components; boxes that lie in one component or fail the
   bound are left out. First each member is checked against the one that comes nearest by the bound, as that joins most of
   what belongs together; then all pairs that are left across components, without any limit.

So no link between different texts is lost, as a link that isn't checked lies within a component. The counts that order
the tokens are a table of fixed size over all rows; they decide only what is cheap, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm.common import LOWER, UPPER, bound_arrow, materialise, tidied

TABLE_BITS = 22
PIECE = 1 << 14
GROUPS, MOST_GROUPS = 256, 1 << 16
SHARED = 3
BLOCK = 800
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MULTIPLIERS = np.array([int(xxhash.xxh3_64_intdigest(b"place", seed=k)) | 1 for k in range(64)], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, cleared when there are many."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_set(text: str | None, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `width` words; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if len(hashes) > 100_000:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    wide = min(n, width)
    runs = n - wide + 1
    total = np.full(runs, np.uint64(wide))
    for k in range(wide):
        total += h[k : k + runs] * _MULTIPLIERS[k]
    total = np.sort(_mix(total))
    new = np.ones(runs, bool)
    np.not_equal(total[1:], total[:-1], out=new[1:])
    return total[new]


def needed(percent: int, a: int, b: int) -> int:
    """The least overlap of sets of a and b tokens over the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def shared_tokens(percent: int) -> int:
    """How many tokens any two different sets over the threshold share at least, up to SHARED."""
    return min(SHARED, -(-percent // (100 - percent))) if percent < 100 else SHARED


def measure(docs: DataFrame, width: int) -> DataFrame:
    """For each row doc_id, n and cid (hash of the set); and from each partition its (piece, counts): how many (document, token) pairs fall to each of 2**TABLE_BITS buckets.

    Each partition counts for itself and gives its table in pieces, as packed integers, so it sends the same few
    megabytes whatever its size.
    """
    pieces, names = (1 << TABLE_BITS) // PIECE, ["doc_id", "n", "cid", "piece", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(1 << TABLE_BITS, np.uint32)
        for batch in batches:
            ns, cids = [], []
            for text in batch.column(1).to_pylist():
                tokens = token_set(text, hashes, width)
                ns.append(len(tokens))
                cids.append(xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63))
                np.add.at(total, (tokens >> np.uint64(64 - TABLE_BITS)).astype(np.int64), np.uint32(1))
            none = pa.nulls(len(ns))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int32()), pa.array(cids, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        parts = [(k, x.astype(np.min_scalar_type(int(x.max()))).tobytes()) for k, x in enumerate(total.reshape(pieces, PIECE)) if x.any()]
        none = pa.nulls(len(parts))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n int, cid bigint, piece int, counts binary")


def bucket_counts(measured: DataFrame) -> np.ndarray:
    """The sum of all partitions' tables: pieces are summed by number, and the driver gets one table of fixed size."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, f"<u{len(x) // PIECE}").astype(np.int64)
        whole = [np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()]  # only the order matters
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(whole, pa.binary())], names=["piece", "counts"])

    table = np.zeros(((1 << TABLE_BITS) // PIECE, PIECE), np.uint32)
    for row in measured.where("piece IS NOT NULL").select("piece", "counts").repartition("piece").mapInArrow(merge, "piece int, counts binary").collect():  # 2**TABLE_BITS numbers
        table[row.piece] = np.frombuffer(row.counts, np.uint32)
    return table.reshape(-1)


def first_tokens(docs: DataFrame, counts: np.ndarray, percent: int, width: int, hot: int, salts: int) -> DataFrame:
    """(key, cid, meta, top): the rare end of each set's tokens, given once for each set and partition.

    meta sorts by rank, low if the set's rare tokens are common, and also holds the size and whether the token is within
    the shorter set's end. Tokens in buckets with over `hot` uses have top, the token itself, and a key that deals their
    sets into `salts` parts, or more, of about `hot`.
    """
    shared, k = docs.sparkSession.sparkContext.broadcast(counts), shared_tokens(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table, seen = WordHashes(), shared.value, set()
        for batch in batches:
            keys, cids, metas, hots = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = token_set(text, hashes, width)
                n = len(tokens)
                cid = xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)
                if not n or doc is None or (cid, n) in seen:
                    continue
                seen.add((cid, n))
                common = table[(tokens >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
                first = np.lexsort((tokens, common))[: n + (-percent * n // 100) + k]
                common = common[first].astype(np.int64)
                rank = 4096 - int(16 * np.log2(common + 1.0).mean())
                core = np.arange(len(first)) < n - needed(percent, n, n) + k
                keys.append(tokens[first])
                cids.append(np.full(len(first), cid))
                metas.append((rank << 33) + (n << 1) + core.astype(np.int64))
                hots.append(np.where(common > hot, cid % np.maximum(salts, -(-common // hot)) + 1, 0))
            if not keys:
                continue
            key, part = np.concatenate(keys), np.concatenate(hots)
            block = np.where(part > 0, _mix(key + part.astype(np.uint64) * _MULTIPLIERS[0]), key).view(np.int64)
            columns = [pa.array(block), pa.array(np.concatenate(cids)), pa.array(np.concatenate(metas)), pa.array(key.view(np.int64), mask=part == 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "cid", "meta", "top"])

    return docs.select("doc_id", "text").mapInArrow(run, "key bigint, cid bigint, meta bigint, top bigint")


def pack_point(tokens: np.ndarray) -> bytes:
    """Group counts of a set, in about half as many groups as it has tokens; a group is the token's low bits, so fewer groups are sums of more. The first byte is the width of a count."""
    groups = min(MOST_GROUPS, max(GROUPS, 1 << max(0, len(tokens) // 2 - 1).bit_length()))
    counts = np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    wide = 1 if counts.max(initial=0) < 256 else 4
    return bytes([wide]) + counts.astype(f"<u{wide}").tobytes()


def unpack_point(point: bytes, groups: int | None = None) -> np.ndarray:
    """The counts, in as many groups as it has or as are asked for."""
    counts = np.frombuffer(point, f"<u{point[0]}", offset=1).astype(np.int64)
    return counts if groups in (None, len(counts)) else counts.reshape(-1, groups).sum(axis=0)


def most_overlap(a: bytes, b: bytes) -> int:
    """The bound by summed minima, in the groups of the coarser point."""
    x, y = unpack_point(a), unpack_point(b)
    least = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, least).sum(axis=0), y.reshape(-1, least).sum(axis=0)).sum())


def points_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, doc_id, n, point) of the classes that `wanted` names by (cid, doc_id)."""

    slot, shared = _bitmap(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            batch = batch.filter(pa.array(_marked(shared.value, batch.column(2).to_numpy())))
            sets = [token_set(text, hashes, width) for text in batch.column(1).to_pylist()]
            cids = [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cids, pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array([pack_point(x) for x in sets], pa.binary())], names=["doc_id", "cid", "n", "point"])

    made = docs.select("doc_id", "text", slot.alias("slot")).mapInArrow(run, "doc_id bigint, cid bigint, n int, point binary")
    named = wanted.select("cid", F.col("doc_id").alias("rep"))
    return made.join(named, "cid").where("doc_id = rep").select("cid", "doc_id", "n", "point").dropDuplicates(["cid"])


def _bitmap(wanted: DataFrame) -> tuple[Column, Broadcast]:
    """A place for each doc_id, and a bitmap of the places of those in `wanted`: a bit or more for each, of 16 MB at most."""
    bits = 1 << min(27, max(20, (8 * wanted.count()).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = wanted.select(slot.alias("s")).groupBy(F.expr("int(s div 32)").alias("w")).agg(F.expr("bit_or(shiftleft(1, int(s % 32)))").alias("m")).toPandas()  # bits / 32 rows at most
    bitmap = np.zeros(bits // 32, np.uint32)
    bitmap[words["w"]] = words["m"].to_numpy(np.int64).astype(np.uint32)
    return slot, wanted.sparkSession.sparkContext.broadcast(bitmap)


def _marked(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 5] >> (slots & 31).astype(np.uint32)) & 1 == 1


def _among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of docs whose doc_id may be in `wanted`, told by the bitmap, so that a join needn't shuffle all texts."""
    slot, shared = _bitmap(wanted)

    @F.pandas_udf("boolean")
    def maybe(s: pd.Series) -> pd.Series:
        return pd.Series(_marked(shared.value, s.to_numpy()))

    return docs.where(maybe(slot)).select("doc_id", "text")


class CountTree:
    """An R-tree over count vectors: leaves of sorted tiles, boxes known by their upper corners, sizes and component."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, components: np.ndarray, leaf: int = 16, fan: int = 8):
        order = self._tile(points, np.lexsort((components, sizes)), leaf)
        self.order, self.points, self.sizes, self.components = order, points[order], sizes[order], components[order]
        self.levels = []  # from the leaves up: begin of each child range, upper corners, least and most size, component or -1
        upper, low, high, comp, step = self.points, self.sizes, self.sizes, self.components, leaf
        while True:
            begins = np.arange(0, len(upper), step)
            least, most = np.minimum.reduceat(comp, begins), np.maximum.reduceat(comp, begins)
            pure = least == most
            upper, low, high = np.maximum.reduceat(upper, begins, axis=0), np.minimum.reduceat(low, begins), np.maximum.reduceat(high, begins)
            self.levels.append((begins, upper, low, high, least, pure))
            comp, step = np.where(pure, least, -np.arange(1, len(begins) + 1)), fan
            if len(begins) <= fan:
                return

    @staticmethod
    def _tile(points: np.ndarray, order: np.ndarray, leaf: int) -> np.ndarray:
        """Slabs by size and component, and in each slab order by the group whose counts differ most."""
        slab = max(leaf, int(np.sqrt(len(order) / leaf)) * leaf)
        parts = []
        for k in range(0, len(order), slab):
            part = order[k : k + slab]
            widest = int(np.argmax(points[part].var(axis=0)))
            parts.append(part[np.argsort(points[part, widest], kind="stable")])
        return np.concatenate(parts)

    def search(self, point: np.ndarray, size: int, component: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the points of other components that the bound leaves, and by how much it could be passed."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            begins, upper, low, high, comp, pure = self.levels[depth]
            ok = ~(pure[nodes] & (comp[nodes] == component)) & (100 * low[nodes] <= 10000 * size // percent) & (100 * high[nodes] >= percent * size)
            nodes = nodes[ok]
            best = np.minimum(upper[nodes], point).sum(axis=1)
            nodes = nodes[(100 + percent) * best >= percent * (size + low[nodes])]
            below = len(self.levels[depth - 1][0]) if depth else len(self.order)
            ends = np.append(begins[1:], below)
            nodes = np.concatenate([np.arange(begins[k], ends[k]) for k in nodes] or [np.zeros(0, np.int64)])
        best = np.minimum(self.points[nodes], point).sum(axis=1)
        sizes = self.sizes[nodes]
        keep = (self.components[nodes] != component) & ((100 + percent) * best >= percent * (size + sizes)) & (100 * np.minimum(size, sizes) >= percent * np.maximum(size, sizes))
        return self.order[nodes[keep]], (best / (size + sizes))[keep]


def components_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that links reach. Labels take their neighbours' minimum, then that of their label, until nothing changes."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")), "links")
    labels = materialise(both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        lower = materialise(lower, "lower")
        jump = lower.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = materialise(lower.join(jump, "to", "left").select("node", F.least("to", "further").alias("comp"), "was"), "labels")
        labels = after.select("node", "comp")
        if after.where("comp <> was").isEmpty():
            break
    return nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, width: int, chunk: int = 64) -> DataFrame:
    """The pairs (a, b) whose whole texts are over the threshold.

    Members travel to their centre's partition in chunks, the centre first, and stream past its set; no group is held.
    Documents that no pair names are left out before the shuffle by a bitmap, then exactly by the join.
    """
    per = pairs.groupBy("a").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    per = materialise(per, "chunks")
    salted = pairs.join(per, "a").select("a", F.col("b").alias("member"), F.pmod(F.hash("b"), F.col("chunks")).alias("chunk"))
    centres = per.select("a", F.col("a").alias("member"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    wanted = salted.unionByName(centres).join(classes.select(F.col("cid").alias("member"), "doc_id"), "member")
    wanted = materialise(wanted, "wanted")
    rows = _among(docs, wanted).join(wanted, "doc_id").select("a", "chunk", (F.col("a") != F.col("member")).alias("later"), "member", "text")
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, centre, at = WordHashes(), np.zeros(0, np.uint64), None
        for batch in batches:
            left, right = [], []
            for a, later, member, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                tokens = token_set(text, hashes, width)
                if not later:
                    centre, at = tokens, a
                    continue
                if at != a:
                    raise ValueError("a member came without its centre")
                same = len(np.intersect1d(centre, tokens, assume_unique=True))
                if 100 * same >= percent * (len(centre) + len(tokens) - same):
                    left.append(a), right.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return materialise(rows.mapInArrow(run, "a bigint, b bigint"), "verified")


def _nearest(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of each b's pairs (a, b) that the bound on their points leaves, the one with the largest bound."""
    left = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"))
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("na").to_numpy(zero_copy_only=False).astype(np.int64) + batch.column("nb").to_numpy(zero_copy_only=False)
            most = np.array([most_overlap(x, y) for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True)], np.int64)
            keep = pa.array((100 + percent) * most >= percent * sizes)
            share = pa.array(most / np.maximum(sizes, 1))
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (batch.column("a"), batch.column("b"), share)], names=["a", "b", "share"])

    scored = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a bigint, b bigint, share double")
    return scored.groupBy("b").agg(F.max(F.struct("share", "a")).alias("m")).select("m.a", "b")


def _across(members: DataFrame, labels: DataFrame, classes: DataFrame, tried: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """Untried pairs across components of a family that an R-tree search leaves; of each member's the `nearest` by the bound, or all.

    A family of up to BLOCK members is one unit. A larger one is cut into pieces of about BLOCK by size band and by
    whether they are in its largest component, from which nothing needs to be searched; a unit is two pieces whose bands
    lie near enough for the threshold. So a unit is bounded whatever the family's size.
    """
    bands, near = 4 / math.log(100 / min(percent, 99)), 5
    inside = materialise(members.join(labels.select(F.col("node").alias("cid"), "comp"), "cid"), "members")
    sizes = inside.groupBy("family", "comp").agg(F.count("*").alias("c")).groupBy("family").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("m"))
    mixed = materialise(sizes.where("size > m.c").select("family", (F.col("size") > BLOCK).alias("large"), F.col("m.comp").alias("main")), "mixed")
    inside = inside.join(mixed, "family").join(classes.select("cid", "n"), "cid")
    in_main = F.col("comp") == F.col("main")
    placed = {"in_main": in_main, "kind": F.when(F.col("large") & in_main, 1).otherwise(0), "band": F.when(F.col("large"), F.floor(F.log("n") * bands)).otherwise(0).cast("int")}
    inside = materialise(inside.withColumns(placed).drop("large", "main"), "inside")
    at = ["family", "kind", "band"]
    cells = materialise(inside.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces")), "cells")
    pieces = cells.select(*at, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("j"))
    other = pieces.select("family", *(F.col(c).alias(f"{c}2") for c in ("kind", "band", "j")))
    ordered = (F.col("kind2") == 1) | (F.struct("band", "j") <= F.struct(F.col("band2").alias("band"), F.col("j2").alias("j")))
    units = pieces.where("kind = 0").join(other, "family").where(ordered & (F.abs(F.col("band") - F.col("band2")) <= near))
    alone = (F.col("kind2") == 0) & (F.col("band") == F.col("band2")) & (F.col("j") == F.col("j2"))
    units = units.withColumns({"u": F.xxhash64("band", "j", "kind2", "band2", "j2"), "alone": alone})
    probes = units.select(*at, "j", "u", F.when(F.col("alone"), 2).otherwise(0).alias("role"))
    targets = units.where("NOT alone").select("family", F.col("kind2").alias("kind"), F.col("band2").alias("band"), F.col("j2").alias("j"), "u", F.lit(1).alias("role"))
    dealt = inside.join(cells, at).withColumn("j", F.pmod(F.xxhash64("cid"), "pieces").cast("int"))
    rows = dealt.join(materialise(probes.unionByName(targets), "units"), [*at, "j"]).select("family", "u", "role", "cid", "comp", "in_main")
    rows = rows.join(classes.select("cid", "n", "point"), "cid").select("family", "u", "role", "cid", "comp", "in_main", "n", "point")
    rows = rows.repartition("family", "u").sortWithinPartitions("family", "u")

    def pairs_of(role: np.ndarray, cid: np.ndarray, comp: np.ndarray, in_main: np.ndarray, n: np.ndarray, packed: np.ndarray) -> set[tuple[int, int]]:
        found_pairs: set[tuple[int, int]] = set()
        targets, probes = np.flatnonzero(role > 0), np.flatnonzero((role != 1) & ~in_main)
        if not len(targets) or not len(probes):
            return found_pairs
        codes = np.unique(comp, return_inverse=True)[1]
        coarse = np.stack([unpack_point(x, GROUPS) for x in packed])
        tree = CountTree(coarse[targets], n[targets], codes[targets])
        for p in probes:
            found, share = tree.search(coarse[p], int(n[p]), int(codes[p]), percent)
            for t in targets[found[np.argsort(-share, kind="stable")]]:
                if (100 + percent) * most_overlap(packed[p], packed[t]) >= percent * int(n[p] + n[t]):
                    found_pairs.add((int(min(cid[p], cid[t])), int(max(cid[p], cid[t]))))
                    if nearest:
                        break
        return found_pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the unit that the next batch may go on with
        names = ("family", "u", "role", "cid", "comp", "in_main", "n", "point")

        def search(arrays: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, int]:
            """Pairs of all units but, if more may come, the last, and where that begins."""
            cuts = np.flatnonzero((arrays[0][1:] != arrays[0][:-1]) | (arrays[1][1:] != arrays[1][:-1])) + 1
            bounds = [0, *cuts.tolist(), len(arrays[0])]
            found = [pair for x, y in pairwise(bounds if last else bounds[:-1]) for pair in pairs_of(*(z[x:y] for z in arrays[2:]))]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"]), bounds[-2]

        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = [batch.column(name).to_numpy(zero_copy_only=False) for name in names]
            if waiting:
                arrays = [np.concatenate(x) for x in zip(waiting, arrays, strict=True)]
            found, rest = search(arrays, False)
            waiting = [x[rest:] for x in arrays]
            yield found
        if waiting:
            yield search(waiting, True)[0]

    return materialise(rows.mapInArrow(run, "a bigint, b bigint").distinct().join(tried, ["a", "b"], "left_anti"), "across")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) after new links between their nodes."""
    a, b = (labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    between = materialise(links.join(a, "a").join(b, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")), "between")
    if between.isEmpty():
        return labels
    joined = components_of(between.select(F.col("a").alias("node")).union(between.select("b")).distinct(), between)
    joined = joined.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return materialise(labels.join(joined, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "merged")


def _blocks(keys: DataFrame, percent: int) -> DataFrame:
    """(family, fmeta, cid, meta, big, top): members of blocks of two or more with their centre, and all that have a top."""
    ordered = Window.partitionBy("key").orderBy("size", "cid")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = keys.withColumn("size", _size(F.col("meta"))).withColumns({"lo": F.min("cid").over(whole), "hi": F.max("cid").over(whole)}).where("lo <> hi OR top IS NOT NULL")
    rows = rows.withColumns({"was": F.lag("cid").over(ordered), "below": F.lag("size").over(ordered)})
    jump = F.col("below").isNull() | (percent * F.col("size") > 100 * F.col("below"))
    rows = rows.withColumn("run", F.sum(jump.cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))).where("was IS NULL OR was <> cid")
    block = Window.partitionBy("key", "run")
    rows = rows.withColumns({"centre": F.min(F.struct("meta", "cid")).over(block), "members": F.count("*").over(block)}).where("members > 1 OR top IS NOT NULL")
    return rows.select(F.col("centre.cid").alias("family"), F.col("centre.meta").alias("fmeta"), "cid", "meta", (F.col("members") > 2).alias("big"), "top")


def _size(meta: Column) -> Column:
    return F.shiftright(meta, 1).bitwiseAND(F.lit((1 << 32) - 1))


def _families(blocks: DataFrame, percent: int) -> DataFrame:
    """(family, cid, hits): centres with the members of their blocks, and how many tokens make them a candidate pair."""
    hot = blocks.where("top IS NOT NULL")
    tops = materialise(hot.groupBy("top").agg(F.min(F.struct("fmeta", "family")).alias("c")), "tops")
    centred = hot.select("top", "cid", "meta").join(tops, "top").select(F.col("c.family").alias("family"), F.col("c.fmeta").alias("fmeta"), "cid", "meta", F.lit(True).alias("big"))
    stars = blocks.drop("top").unionByName(centred).where("family <> cid")
    mine, its = _size(F.col("meta")), _size(F.col("fmeta"))
    core = lambda m: F.col(m).bitwiseAND(F.lit(1)) == 1
    fits = (100 * F.least(mine, its) >= percent * F.greatest(mine, its)) & ((core("meta") & (mine <= its)) | (core("fmeta") & (its <= mine)))
    found = stars.groupBy("family", "cid").agg(F.sum(fits.cast("int")).alias("hits"), F.bool_or("big").alias("big"))
    return found.where(F.col("big") | (F.col("hits") >= shared_tokens(percent))).select("family", "cid", "hits")


def jaccard_components(df: DataFrame, percent: int = 75, width: int = 5, hot: int = 20_000, salts: int = 64) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach), a row for each row of df.

    Two rows link if 100 * intersection >= percent * union of their sets. Null and empty texts, and those without words,
    have no shingles and link with nothing. A row without doc_id has no component and links nothing. Repeated rows get
    equal results; an empty table gives an empty one; columns but doc_id and text don't matter. doc_id is an integer.
    Sets are compared as 64-bit hashes. Tokens in buckets with over `hot` uses are dealt into `salts` parts, more if those
    would be larger than `hot`; their centres meet afterwards.
    """
    if not isinstance(df.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer")
    bound_arrow(df.sparkSession, "4m")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = materialise(measure(rows, width), "sets", lasting=True)
    with tidied(df.sparkSession):
        classes_done = _linked_classes(rows.where("doc_id IS NOT NULL"), measured, percent, width, hot, salts)
    out = measured.where("piece IS NULL").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("cid")).alias("cid"))
    out = out.join(classes_done, "cid", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _linked_classes(docs: DataFrame, measured: DataFrame, percent: int, width: int, hot: int, salts: int) -> DataFrame:
    """(cid, component_id) of every class with tokens."""
    reps = measured.where("n > 0 AND doc_id IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    reps = materialise(reps, "reps")
    keys = first_tokens(docs, bucket_counts(measured), percent, width, hot, salts)
    blocks = materialise(_blocks(keys, percent), "blocks")
    families = materialise(_families(blocks, percent), "families")
    members = families.select("family", "cid").union(families.select("family", "family")).distinct()
    members = materialise(members, "families-whole")
    wanted = materialise(reps.join(members.select("cid").distinct(), "cid", "left_semi"), "wanted-classes")
    classes = materialise(points_of(docs, wanted, width), "classes")

    tried = materialise(_nearest(families.where("hits > 0").select(F.col("family").alias("a"), F.col("cid").alias("b")), classes, percent), "nearest")
    links = _verified(tried, classes, docs, percent, width)
    labels = materialise(components_of(classes.select(F.col("cid").alias("node")), links).select("node", "comp"), "components")
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for nearest in (1, None):
        more = _across(members, labels, classes, tried, percent, nearest)
        if more.isEmpty():
            continue  # each nearest may have been tried, yet others not
        tried = tried.unionByName(more)
        labels = _merged(labels, _verified(more, classes, docs, percent, width))

    ids = labels.join(classes.select(F.col("cid").alias("node"), "doc_id"), "node")
    smallest = ids.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = ids.join(materialise(smallest, "smallest"), "comp").select(F.col("node").alias("cid"), "component_id")
    # Every class has its smallest doc_id; those in blocks, that of their component.
    return materialise(reps.join(linked, "cid", "left").select("cid", F.coalesce("component_id", "doc_id").alias("component_id")), "classes-done", lasting=True)


def keep_one(df: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """df without the rows that belong to the component of a smaller doc_id. Rows without doc_id stay, as do all rows of one doc_id."""
    out = jaccard_components(df, percent, width)
    gone = materialise(out.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone", lasting=True)
    return df.join(gone, df["doc_id"] == gone["gone"], "left_anti")
