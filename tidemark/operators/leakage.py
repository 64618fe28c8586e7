"""Leakage audits: facts that can't have been known are added, whole feature tables are built again, and must be what they were.

Tables are compared by a tree of digests: one aggregation gives count, exclusive or and sum of hashes for every column in
every block of keys; only blocks whose digests differ are opened, and only their rows are joined. So a table that holds
costs one pass each way and no join, and a leak of one cell is found by its column, block and key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ledger import stored

#: The name under which rows stand that only one of the tables has.
ROWS = "(row)"


@dataclass(frozen=True)
class Mutation:
    """What is done to the facts, and whether features must stay as they are or must change (a probe that the audit sees anything at all). `scope`: the feature rows it speaks of."""

    change: Callable[[DataFrame], DataFrame]
    same: bool = True
    scope: Column | None = None


def _block(keys: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")


def digest_tree(table: DataFrame, keys: Sequence[str], blocks: int = 1024) -> DataFrame:
    """column, block, n, x, s: a leaf for every column and block, combined before the shuffle; `blocks` * columns rows at most.

    A hash covers key and value, so values that change places differ; a repeated row counts, as count and sum hold what
    the exclusive or loses. Nulls are values of their own. Columns of maps can't be hashed and are an error.
    """
    values = [c for c in table.columns if c not in keys]
    cell = {ROWS: F.xxhash64(*keys), **{c: F.xxhash64(*keys, F.lit(c), F.col(c).isNull(), c) for c in values}}
    low = F.lit((1 << 40) - 1)  # sums of 2**23 rows a block fit
    leaves = [F.struct(F.lit(c).alias("column"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(low).cast("decimal(20,0)")).alias("s")) for c, h in cell.items()]
    return table.groupBy(_block(keys, blocks).alias("block")).agg(F.count("*").alias("n"), F.array(*leaves).alias("l")).select("block", "n", F.inline("l")).select("column", "block", "n", "x", "s")


def differing(before: DataFrame, after: DataFrame, keys: Sequence[str], blocks: int = 1024) -> DataFrame:
    """column, block where two tables differ: leaves that aren't equal, or that one of them lacks. Columns that only one table has differ in every block."""
    both = digest_tree(before, keys, blocks).select("column", "block", F.struct("n", "x", "s").alias("v"), F.lit(1).alias("side")).unionByName(digest_tree(after, keys, blocks).select("column", "block", F.struct("n", "x", "s").alias("v"), F.lit(2).alias("side")))
    return both.groupBy("column", "block").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n")).where("n < 2 OR a <> b").select("column", "block")


def changed_cells(before: DataFrame, after: DataFrame, keys: Sequence[str], blocks: int = 1024) -> DataFrame:
    """keys, column, before, after (as JSON): the cells of differing blocks that differ, and as `(row)` the keys that one table lacks or has more often.

    Only rows of differing blocks are shuffled. Rows of one key are compared as a sorted list.
    """
    where = F.broadcast(differing(before, after, keys, blocks).select("block").distinct())  # `blocks` rows at most
    values = [c for c in before.columns if c not in keys and c in after.columns]
    opened = lambda df, side: df.withColumn("block", _block(keys, blocks)).join(where, "block", "left_semi").select(*keys, F.lit(side).alias("side"), *[F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}).alias(f"__{k}") for k, c in enumerate(values)])
    both = opened(before, 1).unionByName(opened(after, 2))
    of = lambda k, side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col(f"__{k}"))))
    sides = [F.count_if(F.col("side") == s).cast("string") for s in (1, 2)]
    cells = [F.struct(F.lit(ROWS).alias("column"), *[n.alias(a) for n, a in zip(sides, ("before", "after"), strict=True)])]
    cells += [F.struct(F.lit(c).alias("column"), *[F.array_join(F.transform(of(k, s), lambda v: F.substr(v, F.lit(6), F.length(v) - 6)), ",").alias(a) for s, a in ((1, "before"), (2, "after"))]) for k, c in enumerate(values)]
    return both.groupBy(*keys).agg(F.array(*cells).alias("c")).select(*keys, F.inline("c")).where("before <> after")


def audit(build: Callable[[DataFrame], DataFrame], facts: DataFrame, mutations: Mapping[str, Mutation], keys: Sequence[str], blocks: int = 1024) -> DataFrame:
    """A row for each mutation: check, passed, n_columns, n_blocks, first_column, first_block.

    The features of the facts as they are are built once and kept. An audit that finds nothing in an empty scope passes
    where nothing may change, and fails where something must.
    """
    base, out = stored(build(facts), "audited"), None
    for name, m in mutations.items():
        scoped = lambda df: df if m.scope is None else df.where(m.scope)  # noqa: B023, E731
        found = differing(scoped(base), scoped(build(m.change(facts))), keys, blocks)
        first = F.min(F.struct("column", "block"))
        row = found.agg(F.lit(name).alias("check"), ((F.count("*") == 0) == F.lit(m.same)).alias("passed"), F.countDistinct("column").alias("n_columns"), F.countDistinct("block").alias("n_blocks"), first["column"].alias("first_column"), first["block"].alias("first_block"))
        out = row if out is None else out.unionByName(row)
    return out
