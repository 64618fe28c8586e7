"""Token counts of whole texts, without the tokens.

An Arrow function cuts each text at safe boundaries: before a space that a non-space follows, where the byte-level
pre-tokeniser always starts a new piece, whatever stands around it. So a text's count is the sum of its segments'
counts, a long text is never encoded in one call (but for a stretch without spaces, which is one segment), and a segment seen before is looked up. Unknown segments are
cut further, around a line break between non-spaces and before closing punctuation, and then encoded in batches balanced
by bytes. Counts are cached in two generations, a full one becoming the older; that changes no result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import bound_arrow

_UNSAFE = re.compile(r" (?:\s|\Z)")
_SAFE = re.compile(r"(?= \S)")
_LINE = re.compile(r"(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_CLOSING = ".,;:!?"


def segments(text: str) -> list[str]:
    """Cuts at every safe boundary; joined, the segments are the text."""
    if not text:
        return []
    if _UNSAFE.search(text):
        return [s for s in _SAFE.split(text) if s]
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + s for s in rest]


def smaller(segment: str) -> list[str]:
    """Cuts a segment around single line breaks, and before the punctuation that closes an ASCII word."""
    out = []
    for part in _LINE.split(segment) if "\n" in segment else [segment]:
        word = part.rstrip(_CLOSING)
        if len(word) < len(part) and word and word[-1].isascii() and word[-1].isalpha():
            out += [word, part[len(word) :]]
        else:
            out.append(part)
    return out


class Counter:
    """Counts tokens of segments, each distinct one once, as long as the cache holds it."""

    def __init__(self, path: str, batch_bytes: int, cached: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.batch_bytes, self.cached, self.known, self.older = batch_bytes, cached, {}, {}

    def learn(self, segments: set[str]) -> None:
        """Makes sure that the counts of these segments are known."""
        known, older = self.known, self.older
        cut = {}
        for s in segments:
            if s in older:
                known[s] = older[s]
            else:
                cut[s] = smaller(s)
        parts = {p for ps in cut.values() for p in ps if p not in known}
        known.update((p, older[p]) for p in parts if p in older)
        self._encode([p for p in parts if p not in known])
        for s, ps in cut.items():
            if len(ps) > 1:
                known[s] = sum(map(known.__getitem__, ps))

    def _encode(self, unknown: list[str]) -> None:
        batch, held = [], 0
        for k, segment in enumerate(unknown):
            batch.append(segment)
            held += len(segment.encode())
            if held >= self.batch_bytes or k == len(unknown) - 1:
                for s, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                    self.known[s] = len(e)
                batch, held = [], 0

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        group: list[list[str]] = []
        held = 0
        for k, text in enumerate(texts):
            group.append(segments(text))
            held += len(text)
            if held >= 4 * self.batch_bytes or k == len(texts) - 1:
                if len(self.known) > self.cached:
                    self.known, self.older = {}, self.known
                known = self.known
                self.learn({s for one in group for s in one if s not in known})
                out += [sum(map(known.__getitem__, one)) for one in group]
                group, held = [], 0
        return out


_counters: dict[tuple, Counter] = {}


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024, keep: tuple[str, ...] = (), batch_bytes: int = 1 << 18, cached: int = 300_000) -> DataFrame:
    """The columns `keep`, then n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), a row for each row of df.

    tokenizer: path of a byte-level BPE file of the tokenizers library without normalizer or prefix space. Special
    strings count as that library takes them by default. A null text is empty: no bytes, no tokens. Rows are
    independent, repeated rows get equal counts, an empty table stays empty; columns that aren't kept don't matter.
    """
    bound_arrow(df.sparkSession)
    kept = df.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["n_bytes bigint", "n_tokens bigint", "over_limit boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, batch_bytes, cached)
        if key not in _counters:
            _counters[key] = Counter(*key)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            counts = _counters[key].counts(texts)
            columns = [batch.column(k) for k in range(len(keep))]
            columns += [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, schema)
