"""The prefix trie of conversations by partition refinement.

All sequences start in one class, the root. Turn by turn a class splits by its members' next turn, and a class of one
sequence is retired: the rest of that sequence is a unary chain, which is emitted without any further grouping. What
stays shared is folded back to sums per node: every sequence knows the saving of its chain from each depth to its end
(a running sum), and a node's value is the sum over its members, combined before the shuffle.

Turns stand by digests of role and text (128 bits) and by their bytes; texts are never shuffled. Exact copies of a
sequence are one member with a weight, so copies of any number split nothing. A block of turns is refined in one job:
the class of a turn within it is the class before the block and the chain of digests up to that turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, running_total, text_of, tidied

NO_IDS = hashlib.sha256(b"").hexdigest()
#: Most bytes of a piece of a list of ids that is digested in order.
PIECE = 1 << 20


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, digest, bytes, pos): turns as digests, with their places 1, 2, 3... in each conversation.

    In the order of turn, null first; rows of one turn number follow each other by their digest. A null role or text is
    empty; rows without a conv_id belong to no conversation and are left out. Extra columns don't matter.
    """
    role, text = text_of("role"), text_of("text")
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    said = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return running_total(said, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], F.lit(1), "pos").select("conv_id", "digest", "bytes", "pos")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, bytes) of rebuilt conversations, and (conv_id) of all of them, those without turns too.

    Conversation c takes the first h turns of conversation c - c % family (the remainder of a negative id is negative),
    all of them if it has fewer and none if there is no such conversation, then its own turns after its first h; h is
    the unsigned crc32 of the decimal id modulo `most`.
    """
    h = lambda c: F.crc32(F.col(c).cast("string")) % most
    convs = materialise(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "convs").select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h("conv_id").alias("h"))
    firsts = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    heads = materialise(convs.join(firsts, "base").where(F.col("pos") <= F.col("h")).select("conv_id", F.col("pos").alias("depth"), "digest", "bytes"), "heads")
    taken = convs.join(heads.groupBy("conv_id").agg(F.count("*").alias("taken")), "conv_id", "left")
    own = turns.where(F.col("pos") > h("conv_id")).join(taken, "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.coalesce("taken", F.lit(0))).alias("depth"), "digest", "bytes")
    return materialise(heads.unionByName(own), "rebuilt"), convs.select("conv_id")


def digest_ids(copies: DataFrame) -> DataFrame:
    """(rep, ends): of each rep's conv_ids, decimal, ascending and joined by commas, the lowercase hex SHA-256.

    Ranges of ids become pieces of text side by side; the digest itself, which is sequential by its nature, reads the
    pieces of a rep one after the other and holds one at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, rep, ids, held = TaskContext.get().partitionId(), 0, None, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"rep": rep, "part": part, "number": number, "ids": ",".join(ids)}], schema)

        schema = pa.schema([("rep", pa.int64()), ("part", pa.int32()), ("number", pa.int32()), ("ids", pa.string())])
        for batch in batches:
            for r, c in zip(batch.column(0).to_pylist(), map(str, batch.column(1).to_pylist()), strict=True):
                if ids and (r != rep or held > PIECE):
                    yield piece()
                    number, ids, held = number + 1, [], 0
                rep = r
                ids.append(c)
                held += len(c) + 1
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for r, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or r != rep:
                    if state is not None:
                        done.append((rep, state.hexdigest()))
                    rep, state = r, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], names=["rep", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["rep", "ends"])

    spread = copies.select("rep", "conv_id").repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    pieces = spread.mapInArrow(join, "rep long, part int, number int, ids string")
    return pieces.repartition("rep").sortWithinPartitions("rep", "part", "number").select("rep", "ids").mapInArrow(digest, "rep long, ends string")


def _refined(rows: DataFrame, sequences: DataFrame, root: int, block: int) -> DataFrame | None:
    """(rep, depth, node, n_convs) of all turns that a sequence shares with another; node: the smallest member."""
    active, depth, found = sequences.where("n > 0").select("rep", F.lit(root).cast("long").alias("class")), 0, []
    while True:
        ahead = rows.where((F.col("depth") > depth) & (F.col("depth") <= depth + block)).join(active, "rep")
        lists = ahead.groupBy("rep", "w", "class").agg(F.sort_array(F.collect_list(F.struct("depth", "digest"))).alias("t"))  # at most `block` turns each
        chain = lambda k: F.sha2(F.array_join(F.slice(F.col("t")["digest"], 1, k), ""), 256)
        keyed = lists.select("rep", "w", "class", F.explode(F.transform(F.sequence(F.lit(1), F.size("t")), lambda k: F.struct((F.lit(depth) + k).cast("long").alias("depth"), chain(k).alias("key")))).alias("x"))
        keyed = materialise(keyed.select("rep", "w", "class", "x.*"), "keyed")
        classes = keyed.groupBy("class", "depth", "key").agg(F.min("rep").alias("node"), F.sum("w").alias("n_convs"), F.count("*").alias("size")).where("size > 1")
        shared = materialise(keyed.join(classes, ["class", "depth", "key"]).select("rep", "depth", "node", "n_convs"), "shared")
        if shared.isEmpty():
            break
        found.append(shared)
        depth += block
        active = shared.where(F.col("depth") == depth).select("rep", F.col("node").alias("class"))
        if active.isEmpty():
            break
    return reduce(DataFrame.unionByName, found) if found else None


def prefix_trie(turns: DataFrame, members: DataFrame, block: int = 8) -> DataFrame:
    """Nodes of the trie of all members: conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth (1, 2, 3... without gaps), digest (string), bytes; members: conv_id (long, no null). A member
    without turns ends at the root. saved_tokens is the sum over a node's subtree of (n_convs - 1) times the bytes of
    the node's last turn. Repeated sequences are members of the same nodes; repeated conv_ids in members count once.
    Without members there are no nodes. `block`: turns refined in one job; it changes no result.

    Work grows with all turns; jobs with the depth at which two different sequences still agree, over `block`.
    """
    prints = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("depth", "digest")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "digest", "depth")).alias("b"), F.count("*").alias("n"))
    each = materialise(members.distinct().join(prints, "conv_id", "left").na.fill(0, ["a", "b", "n"]), "prints")
    sequences = materialise(each.groupBy("a", "b", "n").agg(F.min("conv_id").alias("rep"), F.count("*").alias("w")), "sequences")
    root, total, different = sequences.agg(F.min("rep"), F.sum("w"), F.count("*")).first()
    copies = each.join(sequences.where("w > 1"), ["a", "b", "n"]).select("rep", "conv_id")
    rows = materialise(turns.withColumnRenamed("conv_id", "rep").join(sequences.select("rep", "w", "n"), "rep"), "rows")
    shared = _refined(rows, sequences, root or 0, block)

    info = sequences.select("rep", "n")
    if shared is None:
        info = info.withColumns({"s": F.lit(0).cast("long"), "until": F.lit(0).cast("long"), "origin": F.lit(root).cast("long")})
    else:
        of_others = F.when(F.col("node") != F.col("rep"), F.col("depth"))
        chains = shared.groupBy("rep").agg(F.max("depth").alias("s"), F.max(of_others).alias("until"), F.max_by("node", of_others).alias("origin"))
        info = info.join(chains, "rep", "left").na.fill(0, ["s", "until"]).withColumn("origin", F.coalesce("origin", F.lit(root).cast("long")))
    # From `first` on a sequence is the smallest member of its nodes; it branches off from the node of `origin`.
    leaf = F.when(F.col("n") == 0, F.lit(different == 1)).otherwise(F.col("s") < F.col("n")).cast("long")
    info = info.join(digest_ids(copies), "rep", "left").select("rep", "s", (F.col("until") + 1).alias("first"), "origin", leaf.alias("leaf"), F.coalesce("ends", F.sha2(F.col("rep").cast("string"), 256)).alias("all_ends"))
    info = materialise(info, "info")
    saved = F.col("bytes") * (F.col("w") - (F.col("depth") >= F.col("first")).cast("long"))
    chain = rows.drop("digest").join(info, "rep").withColumn("ends", F.when(F.col("depth") == F.col("n"), F.col("all_ends"))).drop("all_ends")
    chain = running_total(chain.withColumn("saved", saved), "rep", [F.col("depth").desc()], F.col("saved"), "below")

    nothing = "depth long, rep long, many long, kids long, leaves long, sums long, their_ends string"
    sums = rows.sparkSession.createDataFrame([], nothing)
    if shared is not None:
        sums = shared.join(chain.drop("s", "origin"), ["rep", "depth"]).groupBy("depth", "node").agg(
            F.max("n_convs").alias("many"),
            F.sum(((F.col("depth") + 1 >= F.col("first")) & (F.col("depth") < F.col("n"))).cast("long")).alias("kids"),
            F.sum("leaf").alias("leaves"),
            F.sum("below").alias("sums"),
            F.max("ends").alias("their_ends"),
        ).withColumnRenamed("node", "rep")
    alone = F.col("depth") > F.col("s")
    pick = lambda own, of_sums: F.when(alone, own).otherwise(F.col(of_sums))
    nodes = chain.where("depth >= first").join(sums, ["depth", "rep"], "left").select(
        F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("first"), F.col("origin")).otherwise(F.col("rep")).alias("parent_conv_id"),
        pick(F.col("w"), "many").alias("n_convs"), pick((F.col("depth") < F.col("n")).cast("long"), "kids").alias("n_children"), pick(F.lit(1).cast("long"), "leaves").alias("n_leaves"),
        pick(F.col("below"), "sums").alias("saved_tokens"), F.coalesce(pick(F.col("ends"), "their_ends"), F.lit(NO_IDS)).alias("ends_sha256"),
    )
    whole = chain.agg(F.sum("saved")).first()[0] or 0
    branches = info.join(sequences.select("rep", "n"), "rep")
    top = branches.agg(F.sum(((F.col("first") == 1) & (F.col("n") > 0)).cast("long")).alias("kids"), F.sum("leaf").alias("leaves"), F.max(F.when(F.col("n") == 0, F.col("all_ends"))).alias("ends")).where(F.lit(root is not None))
    long = lambda x: F.lit(x).cast("long")
    top = top.select(long(root).alias("conv_id"), long(0).alias("depth"), long(None).alias("parent_conv_id"), long(total).alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), long(whole).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"))
    return nodes.unionByName(top)


def conversation_trie(conversations: DataFrame, family: int = 5, most: int = 9, block: int = 8) -> DataFrame:
    """The trie of rebuilt conversations; see `ordered`, `rebuilt` and `prefix_trie` for nulls, ties, repeats and empty tables. Long texts count whole, by digest and bytes."""
    with tidied(conversations.sparkSession):
        turns, members = rebuilt(ordered(conversations), family, most)
        return materialise(prefix_trie(turns, members, block), "trie", lasting=True)

