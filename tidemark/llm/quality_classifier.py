"""Quality of documents: random-indexing word vectors, pooled, and a small network with calibrated probabilities.

Each hashed word has a sparse random index vector; its context vector sums the index vectors of its neighbours in the
training texts, partition by partition, then over partitions. A document is the mean and spread of its words' vectors
and a few statistics of its tokens. A two-layer network (numpy) is fitted to a bounded sample of labelled rows, and its
temperature to a part of them kept back. Sizes that reach the driver are fixed by parameters: the vector table and at
most `sample` pooled rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_arrow, materialise, tidied

TOKENS = re.compile(r"\w+|[^\w\s]+")
STATS = 10


@dataclass(frozen=True)
class Settings:
    buckets: int = 8192
    dims: int = 48
    nonzero: int = 6
    reach: int = 2
    hidden: int = 32
    epochs: int = 60
    sample: int = 6000
    parts: int = 6
    seed: int = 7


class Buckets(dict):
    """Buckets of tokens; words of one letter case and digits only keep that much of their shape."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        kind = "0" * min(len(token), 8) if token.isdigit() else token.lower() + ("^" if len(token) > 1 and token.isupper() else "")
        found = self[token] = zlib.crc32(kind.encode()) % self.size
        return found


def index_vectors(s: Settings) -> np.ndarray:
    rng = np.random.default_rng(s.seed)
    out = np.zeros((s.buckets, s.dims), np.float32)
    for row in out:
        row[rng.choice(s.dims, s.nonzero, replace=False)] = rng.choice([-1.0, 1.0], s.nonzero)
    return out


def tokens_of(text: str | None) -> list[str]:
    return TOKENS.findall(text or "")


def context_sums(buckets: np.ndarray, index: np.ndarray, total: np.ndarray, reach: int) -> None:
    """Adds the index vectors of neighbours to the rows of total."""
    for d in range(1, reach + 1):
        if len(buckets) > d:
            np.add.at(total, buckets[d:], index[buckets[:-d]])
            np.add.at(total, buckets[:-d], index[buckets[d:]])


def word_vectors(total: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Unit context vectors, each with a share of the word's own index vector; a word without contexts keeps that alone."""
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    own = index / np.linalg.norm(index, axis=1, keepdims=True)
    return (np.divide(total, norm, out=np.zeros_like(total), where=norm > 0) + own).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    """Mean and spread of the vectors of all tokens of a text, and statistics; zeros for one without tokens."""
    text = text or ""
    tokens = tokens_of(text)
    n, dims = len(tokens), vectors.shape[1]
    out = np.zeros(2 * dims + STATS, np.float32)
    if not n:
        return out
    ids = np.fromiter(map(buckets.__getitem__, tokens), np.int64, n)
    if n > 3000:
        used, counts = np.unique(ids, return_counts=True)
        rows, weights = vectors[used], (counts / n).astype(np.float32)[:, None]
        mean = (rows * weights).sum(axis=0)
        spread = ((rows - mean) ** 2 * weights).sum(axis=0)
    else:
        rows = vectors[ids]
        mean, spread = rows.mean(axis=0), rows.var(axis=0)
    lines = text.split("\n")
    words = sum(t[0].isalnum() for t in tokens)
    size = len(text)
    trigrams = np.unique(ids[2:] + 8192 * (ids[1:-1] + 8192 * ids[:-2])) if n > 2 else ids
    out[:dims], out[dims : 2 * dims] = mean, np.sqrt(spread)
    out[2 * dims :] = [
        np.log1p(n) / 5, len(set(tokens)) / n, len(trigrams) / max(n - 2, 1), len(set(lines)) / len(lines), words / n, sum(map(len, tokens)) / size,
        sum(1 for t in tokens if t.isupper() and len(t) > 1) / n, sum(1 for t in tokens if t.isdigit()) / n, min(n / len(lines), 100) / 50, np.log1p(max(map(len, tokens))) / 5,
    ]
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, s: Settings) -> Network:
    """Adam on the log loss with weight decay; every fifth row sets the temperature alone. Without two classes, a constant."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    rng = np.random.default_rng(s.seed)
    d = x.shape[1] if len(x) else 2 * s.dims + STATS
    rate = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2 or len(y) < 20:
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(rate / (1 - rate))))
    kept = np.arange(len(y)) % 5 == 4
    xt, yt = x[~kept], y[~kept]
    scale = xt.std(axis=0)
    net = Network(xt.mean(axis=0), np.where(scale > 1e-6, scale, 1.0), rng.normal(0, d**-0.5, (d, s.hidden)), np.zeros(s.hidden), rng.normal(0, s.hidden**-0.5, s.hidden), 0.0)
    z = (xt - net.mean) / net.scale
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(s.epochs):
        order = rng.permutation(len(z))
        for k in range(0, len(z), 64):
            a, t = z[order[k : k + 64]], yt[order[k : k + 64]]
            h = np.tanh(a @ weights[0] + weights[1])
            e = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -40, 40))) - t) / len(t)
            back = np.outer(e, weights[2]) * (1 - h * h)
            step += 1
            for j, g in enumerate((a.T @ back + 1e-3 * weights[0], back.sum(axis=0), h.T @ e + 1e-3 * weights[2], np.array([e.sum()]))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                weights[j] -= 0.003 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    logit = net.logits(x[kept])
    losses = {t: np.logaddexp(0, -(2 * y[kept] - 1) * logit / t).mean() for t in np.exp(np.linspace(-1.5, 2.5, 81))}
    net.temperature = float(min(losses, key=losses.get))
    return net


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network
    settings: Settings

    def scores(self, texts: list[str | None], buckets: Buckets) -> np.ndarray:
        return self.network.probabilities(np.stack([pooled(t, self.vectors, buckets) for t in texts]).astype(np.float64)) if texts else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", s: Settings | None = None) -> Classifier:
    """Fits to labelled rows that aren't held out, at most `sample` of them: those of the smallest hashes of their ids.

    Labels other than 0 and 1 and ids with several labels are left out, as are labels without a document. If several
    rows have one id, each is a training row. Inputs are the texts alone.
    """
    s = s or Settings()
    bound_arrow(documents.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("__y"))
    chosen = known.where("y = __y").select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("k"), "text", "y")
    sample = sample.repartition(s.parts, "k")
    index = index_vectors(s)
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = Buckets(s.buckets), np.zeros((s.buckets, s.dims), np.float32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = tokens_of(text)
                context_sums(np.fromiter(map(buckets.__getitem__, tokens), np.int64, len(tokens)), shared.value, total, s.reach)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    total = np.zeros((s.buckets, s.dims), np.float64)
    with tidied(documents.sparkSession):  # tables of fixed size, made side by side; the driver holds a few at a time, whatever their number
        for row in materialise(sample.select("text").mapInArrow(contexts, "total binary"), "contexts").toLocalIterator():
            total += np.frombuffer(row.total, np.float32).reshape(total.shape)
    vectors = word_vectors(total, index)
    given = documents.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(s.buckets)
        for batch in batches:
            rows = [pooled(t, given.value, buckets).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["k", "y", "x"])

    y_type = sample.schema["y"].dataType.simpleString()
    found = sample.mapInArrow(pool, f"k bigint, y {y_type}, x binary").toPandas().sort_values(["k", "y"], kind="stable")
    x = np.stack([np.frombuffer(b, np.float32) for b in found["x"]]) if len(found) else np.zeros((0, 2 * s.dims + STATS))
    return Classifier(vectors, fit(x, found["y"].to_numpy(), s), s)


def classify(documents: DataFrame, model: Classifier, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each document.

    score is the probability of label 1, of empty and null texts too (they have no tokens); predicted is 1 if it reaches
    the threshold. Rows are independent: repeated rows get equal scores, an empty table stays empty, other columns don't
    matter. The model is broadcast; its size is fixed by its settings.
    """
    bound_arrow(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(shared.value.settings.buckets)
        for batch in batches:
            scores = shared.value.scores(batch.column(1).to_pylist(), buckets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
