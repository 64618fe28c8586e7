"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries come without a regex. Code points become classes by array lookups; a small automaton tells where pieces
start. Its transition functions form a finite monoid, so composing them is one table lookup, and that product is
associative: blocks of the text are reduced side by side, the block products are scanned, and each block then replays
from its known start state, all blocks at once. The slices between boundaries feed a cached pair merging. Ids and the
byte offset of every token are kept, so any run of tokens can be decoded to its place in the text.

The automaton stands for this pattern (a fixed value of the vocabulary):
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import base64
import contextlib
import functools
import heapq
import struct
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from tidemark.llm.common import bound_arrow

# Classes of code points, then those that depend on what follows.
LETTER, NUMBER, OTHER, SPACE, BLANK = 0, 1, 2, 3, 4
SPACE_LAST, BLANK_LAST, SHORT, LONG, BREAK = 5, 6, 7, 8, 9  # the last of a run before a non-space; an apostrophe of 's and of 're; a document's end
#: Code points of the property White_Space (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
END = 0x110000
# States: what the open piece is.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_BLANKS, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts here."""
    if kind == BREAK:
        return FRESH, True
    if state in (ONE_LEFT, TWO_LEFT) and kind == LETTER:
        return (FRESH if state == ONE_LEFT else ONE_LEFT), False
    if kind in (SPACE, BLANK):
        return IN_BLANKS, state != IN_BLANKS
    if kind == SPACE_LAST:
        return AFTER_SPACE, True
    if kind == BLANK_LAST:
        return FRESH, True
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(kind, IN_OTHER)
    if state in (run, AFTER_SPACE):
        return run, False
    return {SHORT: ONE_LEFT, LONG: TWO_LEFT}.get(kind, run), True


@functools.cache
def _tables() -> tuple[np.ndarray, ...]:
    """Class by code point; next state and start flag by (state, class); the monoid's generators, products and effects."""
    classes = np.full(END + 1, OTHER, np.uint8)
    for code in range(END):
        major = unicodedata.category(chr(code))[0]
        if major in "LN":
            classes[code] = LETTER if major == "L" else NUMBER
    classes[WHITE] = BLANK
    classes[0x20], classes[END] = SPACE, BREAK
    steps = [[_step(s, c) for c in range(10)] for s in range(8)]
    following = np.array([[x[0] for x in row] for row in steps], np.uint8)
    starts = np.array([[x[1] for x in row] for row in steps], bool)
    generators = [tuple(following[:, c]) for c in range(10)]
    elements = {f: k for k, f in enumerate(dict.fromkeys([tuple(range(8)), *generators]))}
    todo = list(elements)
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    effects = np.array(list(elements), np.uint8)
    product = np.array([[elements[tuple(g[x] for x in f)] for g in elements] for f in elements], np.uint16)
    return classes, following, starts, np.array([elements[g] for g in generators], np.uint16), product, effects


def _entry_states(elements: np.ndarray, product: np.ndarray, effects: np.ndarray) -> np.ndarray:
    """The state before each element, the first being FRESH: an exclusive scan of products, by blocks."""
    n = len(elements)
    if n <= 64:
        states, out = 0, np.empty(n, np.uint8)
        for k in range(n):
            out[k] = states
            states = effects[elements[k], states]
        return out
    width = 1 << max(3, (n.bit_length() // 2))
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    total = grid[0].copy()
    for k in range(1, width):
        total = product[total, grid[k]]
    state = _entry_states(total, product, effects)
    out = np.empty((width, rows), np.uint8)
    for k in range(width):
        out[k] = state
        state = effects[grid[k], state]
    return out.T.reshape(-1)[:n]


def piece_starts(codes: np.ndarray) -> np.ndarray:
    """Where pieces start, in code points that END cuts into documents; every END is a start of its own."""
    table, _, starts, generators, product, effects = _tables()
    kinds = table[np.minimum(codes, END)]
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    after = np.full(n, BREAK, np.uint8)
    after[:-1] = kinds[1:]
    last = (after < SPACE)
    kinds[last & (kinds == SPACE)] = SPACE_LAST
    kinds[last & (kinds == BLANK)] = BLANK_LAST
    quotes = np.flatnonzero(codes == 0x27)
    if len(quotes):
        padded = np.concatenate([codes, np.full(2, END, codes.dtype)])
        a, b = padded[quotes + 1], padded[quotes + 2]
        is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        kinds[quotes[is_(a, "stmd")]] = SHORT
        kinds[quotes[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = LONG
    states = _entry_states(generators[kinds], product, effects)
    return np.flatnonzero(starts[states, kinds])


class Bpe:
    """Ranks, and the pieces merged lately in two generations: a full one becomes the older, whose pieces come back when they are used."""

    def __init__(self, ranks_path: str, cached: int = 100_000):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.merger = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})  # merges what it gets as one piece
        self.cached, self.known, self.older = cached, {}, {}

    def merge(self, piece: bytes) -> list[int]:
        """Merges the pair of the lowest rank, the leftmost among equals, until none is left."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) <= 200:
            with contextlib.suppress(UnicodeDecodeError):
                return self.merger.encode_ordinary(piece.decode())
        return self._merge_long(piece)

    def _merge_long(self, piece: bytes) -> list[int]:
        """A heap of the pairs; n log n for a piece of any length."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))
        alive = [True] * n
        rank_at = lambda a, b: ranks.get(piece[a : end[b]])
        heap = [(r, a, a + 2) for a in range(n - 1) if (r := ranks.get(piece[a : a + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, stop = heapq.heappop(heap)
            if not alive[a] or (b := end[a]) >= n or end[b] != stop:
                continue
            alive[b] = False
            end[a] = stop
            if stop < n:
                before[stop] = a
                if (r := rank_at(a, stop)) is not None:
                    heapq.heappush(heap, (r, a, end[stop]))
            if (p := before[a]) >= 0 and (r := rank_at(p, a)) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[piece[a : end[a]]] for a in range(n) if alive[a]]

    def ids_of(self, piece: str) -> bytes:
        """Ids of a piece, as little-endian unsigned 32-bit integers."""
        found = self.known.get(piece)
        if found is None:
            found = self.older.get(piece) or struct.pack(f"<{len(ids := self.merge(piece.encode()))}I", *ids)
            if len(piece) <= 64:
                if len(self.known) >= self.cached:
                    self.known, self.older = {}, self.known
                self.known[piece] = found
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids, as bytes."""
        joined = "".join(t + "\0" for t in texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1 if texts else np.zeros(0, np.int64)
        codes[ends] = END
        starts = piece_starts(codes)
        cuts = starts.tolist()
        pieces = [joined[a:b] for a, b in pairwise(cuts)]  # ends of documents among them
        ids = list(map(self.known.get, pieces))
        firsts = np.searchsorted(starts, ends).tolist()
        for k in firsts[:-1]:
            ids[k] = b""
        for k, found in enumerate(ids):
            if found is None:
                ids[k] = self.ids_of(pieces[k])
        return [b"".join(ids[a:b]) for a, b in zip([0, *(k + 1 for k in firsts)], firsts)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """The byte at which each token starts, then the length of all."""
        lengths = [len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()]
        return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """Loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Slices of at most about `most` characters; a longer text stands alone."""
    start = held = 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield start, k
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def encode_documents(df: DataFrame, ranks: str, text: str = "text", keep: tuple[str, ...] = (), offsets: bool = True, decoded: bool = False, chars: int = 1 << 18) -> DataFrame:
    """The columns `keep`, then ids (binary, little-endian unsigned 32-bit), n_tokens, offsets (binary like ids: where each token starts, in UTF-8 bytes) and, if asked for, decoded (binary: the ids' bytes, decoded from them).

    ranks: path of a tiktoken file of a byte-level vocabulary. Every whole text is encoded without special tokens; a
    null text is empty and has no ids. Rows are independent: repeated rows get equal ids, an empty table stays empty;
    columns that aren't kept don't matter, whatever their names; a kept one that has the name of a result is refused.
    Decoding in the same pass saves a second set of Python workers.
    """
    made = ["ids", "n_tokens", *["offsets"] * offsets, *["decoded"] * decoded]
    if clash := set(keep) & set(made):
        raise ValueError(f"columns {sorted(clash)} are results; rename them before")
    bound_arrow(df.sparkSession)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema]
    schema = ", ".join([*kept, "ids binary", "n_tokens bigint", *["offsets binary"] * offsets, *["decoded binary"] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(ranks)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            ids = [x for a, b in _groups([len(t) for t in texts], chars) for x in model.encode(texts[a:b])]
            columns = [batch.column(k) for k in range(len(keep))]
            columns += [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if offsets:
                columns.append(pa.array([model.offsets(x)[:-1].astype("<u4").tobytes() for x in ids], pa.binary()))
            if decoded:
                columns.append(pa.array([model.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made])

    # By place, as a kept column may be called like anything.
    return df.select(*keep, df[text]).mapInArrow(run, schema)


def decode_documents(df: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the decoded bytes (binary) of the column ids; null ids give null, no ids give no bytes."""
    bound_arrow(df.sparkSession)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out] + [f"`{out}` binary"])
    names = [f.name for f in df.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(ranks)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*names, out])

    return df.select(*names).mapInArrow(run, schema)
