"""Importance resampling towards a target distribution over hashed features.

Documents become sparse rows of counts by bucket, persisted as blocks of a CSR matrix (row pointers, column indices and
counts of a batch of documents). Column sums of the blocks of a corpus are its distribution; gains compare two of them;
the product of the matrix with the vector of gains is every document's weight. Texts are read once. Draws without
replacement are the highest scores, weights with Gumbel noise that a hash of the document's id gives.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_arrow, materialise, running_total, slices, tidied

#: Bytes to word bytes: A-Z lower-cased; digits, a-z and all beyond ASCII stay; the rest separates.
_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

#: Code points of a block's texts, at most but for a longer single text.
BLOCK = 1 << 20


def features_of(text: str | None, longest: int = 1) -> Counter:
    """Counts of all runs of 1 to `longest` consecutive words, joined by one space, as UTF-8."""
    words = (text or "").encode().translate(_WORDS).split()
    found = Counter(words)
    for n in range(2, longest + 1):
        found.update(map(b" ".join, zip(*(words[k:] for k in range(n)))))
    return found


def csr(counts: list[Counter], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pointers, column indices (ascending in a row, without repeats) and counts."""
    sizes = [len(c) for c in counts]
    hashed = np.fromiter((crc32(w) for c in counts for w in c), np.int64, sum(sizes)) % buckets
    values = np.fromiter((n for c in counts for n in c.values()), np.int64, sum(sizes))
    cells = np.repeat(np.arange(len(counts), dtype=np.int64), sizes) * buckets + hashed
    order = np.argsort(cells, kind="stable")
    cells, values = cells[order], values[order]
    firsts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
    values = np.add.reduceat(values, firsts) if len(firsts) else values
    cells = cells[firsts]
    return np.searchsorted(cells, np.arange(len(counts) + 1, dtype=np.int64) * buckets), cells % buckets, values


def count_blocks(df: DataFrame, buckets: int, longest: int = 1, text: str = "text", keep: str | None = None) -> DataFrame:
    """A row for each block: ids (array of the column `keep`), n_words and n_features (arrays), pointers, indices and counts (binary, little-endian 64, 32 and 32 bits)."""
    bound_arrow(df.sparkSession)
    kind = df.schema[keep].dataType.simpleString() if keep else "int"

    def block(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        counts = [features_of(t, longest) for t in texts]
        pointers, indices, values = csr(counts, buckets)
        n = [sum(c.values()) for c in counts]
        words = n if longest == 1 else [sum(v for w, v in c.items() if b" " not in w) for c in counts]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), ids), pa.array([words], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))]
        arrays += [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((pointers, "<i8"), (indices, "<u4"), (values, "<u4"))]
        return pa.RecordBatch.from_arrays(arrays, names=["ids", "n_words", "n_features", "pointers", "indices", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], BLOCK):
                yield block(pa.concat_arrays([batch.column(0).slice(a, b - a)]), texts[a:b])

    schema = f"ids array<{kind}>, n_words array<bigint>, n_features array<bigint>, pointers binary, indices binary, counts binary"
    return df.select(F.col(keep) if keep else F.lit(0), df[text]).mapInArrow(run, schema)


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """Sums of all columns; a task sends one row for each bucket it met, the driver gets `buckets` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for indices, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(sums, np.frombuffer(indices, "<u4"), np.frombuffer(counts, "<u4").astype(np.int64))
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[met])], names=["bucket", "n"])

    found = blocks.select("indices", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in found:
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed probabilities, rounded down."""
    s_all, t_all, m = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + m) / ((s + 1) * (t_all + m)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(blocks: DataFrame, vector: np.ndarray, id_type: str) -> DataFrame:
    """(id, n_words, n_features, weight): the product of the blocks with the vector, in 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words, n = (batch.column(c)[k].values for c in range(3))
                pointers, indices, counts = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in ((3, "<i8"), (4, "<u4"), (5, "<u4")))
                sums = np.concatenate([[0], np.cumsum(vector[indices] * counts)])
                yield pa.RecordBatch.from_arrays([ids, words, n, pa.array(np.diff(sums[pointers]))], names=["id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, f"id {id_type}, n_words bigint, n_features bigint, weight bigint")


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: str = "2024", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every document doc_id, n_features, weight, score and rank (1, 2, 3... by score, ties to the smaller doc_id; null if not drawn), all long.

    Features are the runs of 1 to `longest` words, hashed by crc32 into buckets; gains come from all documents and all
    target texts. Drawn are floor(percent * N / 100) of the N documents with at least `least_words` words. Whole texts
    count, however long. A null or empty text has no features and weight 0; a null doc_id has the noise of an empty one,
    and ranks before others of its score. Repeated rows get equal scores and successive ranks. An empty table gives no
    rows, an empty target a flat distribution. Extra columns don't matter.
    """
    with tidied(documents.sparkSession):
        blocks = materialise(count_blocks(documents, buckets, longest, text, doc_id), "csr")
        vector = gains(column_sums(blocks, buckets), column_sums(count_blocks(target, buckets, longest, text), buckets))
        weighed = weigh(blocks, vector, documents.schema[doc_id].dataType.simpleString())
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
        scored = materialise(weighed.select(F.col("id").alias(doc_id), "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")), "scored")
        able = F.col("n_words") >= least_words
        drawn = scored.where(able).count() * percent // 100
        ranked = running_total(scored.where(able), None, [F.col("score").desc(), F.col(doc_id), F.col("weight"), F.col("n_features")], F.lit(1), "rank")
        ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
        rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
        return materialise(ranked.unionByName(rest).select(doc_id, "n_features", "weight", "score", "rank"), "resampled", lasting=True)
