"""BPE encoding by content-defined chunks, and decoding.

A rolling hash over the last code points cuts texts into chunks, wherever its low bits are zero; so equal passages fall
into equal chunks, whatever stands before them. A distinct chunk is encoded once while a task's cache holds it, without
its first and last word, which the cut may have broken. Then the joins are repaired: the stretch from the last whole
word of one chunk to the first whole word of the next is encoded anew, and must agree with what both chunks have for
these words; where it doesn't, the next chunks are drawn in, until it does or the whole text is encoded at once.

The tokenizer drops white space and never merges across it (checked when it is loaded), so words between ASCII spaces
are encoded each by itself, and a distinct word once. Where the tokenizer splits letters from punctuation, so are words
here; a block of new chunks is split as one array of bytes, its distinct pieces are looked up, and ids gathered from them.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import bound_arrow, slices

#: Code points under the rolling hash, and the multiplier of its polynomial.
WINDOW, FACTOR = 16, 0x9E3779B1
#: Below this code point nothing composes, and lower case keeps letters letters but for U+0130.
PLAIN = "\u0250"
#: Punctuation that closes a word: all of ASCII.
CLOSING = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Kinds of bytes: ASCII spaces, letters and punctuation; all others are 0.
SPACE, LETTER, PUNCTUATION = 1, 2, 3
KIND = np.zeros(256, np.uint8)
for _of, _kind in ((b" \t\n\r\v\f", SPACE), (bytes(b for b in range(128) if chr(b).isalpha()), LETTER), (CLOSING, PUNCTUATION)):
    KIND[list(_of)] = _kind
#: UTF-8 starts with this byte or a greater one from U+0240 on, so for all that isn't PLAIN.
NOT_PLAIN = 0xC9
#: Bytes of chunks that are split at once.
BLOCK = 1 << 20


def chunk_starts(codes: np.ndarray, bits: int, least: int) -> list[int]:
    """Where chunks of a text start: a cut stands behind a window whose hash has `bits` zeros, if the chunk has `least` code points."""
    if len(codes) <= least:
        return [0] if len(codes) else []
    hashes, width = codes, 1
    while width < WINDOW:  # a window's hash from those of its halves
        hashes = hashes[:-width] * np.uint32(pow(FACTOR, width, 1 << 32)) + hashes[width:]
        width *= 2
    hashes ^= hashes >> np.uint32(15)
    hashes *= np.uint32(0x85EBCA6B)
    cuts = [0]
    for at in (np.flatnonzero(hashes >> np.uint32(32 - bits) == 0) + WINDOW).tolist():
        if at - cuts[-1] >= least and at < len(codes):
            cuts.append(at)
    return cuts


class Generations(dict):
    """A cache of two generations by size: a full one becomes the older, from which what is used comes back."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.size, self.older = most, 0, {}

    def __missing__(self, key):
        if (found := self.older.get(key)) is not None:
            self.add(key, found[0], found[1])
            return found[0], found[1]
        return None

    def add(self, key, value, size: int) -> None:
        if self.size > self.most:
            self.older, self.size = dict(self), 0
            self.clear()
        self[key] = (value, size)
        self.size += size


class Chunked:
    """The tokenizer with its caches. Ids are little-endian unsigned 32-bit integers, as bytes."""

    def __init__(self, path: str, bits: int = 9, least: int = 128, cache_bytes: int = 24 << 20, cached_words: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits, self.least = bits, max(least, WINDOW + 1)
        self.chunks, self.words, self.older, self.cached_words = Generations(cache_bytes), {}, {}, cached_words
        self.names: dict[int, str] = {k: v for v, k in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.token_at = [self.names.get(k, "") for k in range(max(self.names) + 1)]
        self.decimal_at = [str(k) for k in range(len(self.token_at))]
        self.tokens, self.decimals = pa.array(self.token_at, pa.string()), pa.array(self.decimal_at, pa.string())
        self.encoded_chunks = self.widened = 0
        for gap in " \t\n\r\v\f":
            if self._ids(f"one{gap}two") != self._ids("one") + self._ids("two"):
                raise ValueError("this tokenizer keeps white space")
        self.joined_by_space = self.tokenizer.decoder is None
        # Tokens that end a piece, if the vocabulary marks them and case doesn't matter.
        self.ends = None
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            split = all(self._ids(f"one{c}two") == self._ids("one") + self._ids(f"{c}two") for c in CLOSING.decode())
            if split and self._ids("\u00c9t\u00c9, Word") == self._ids("\u00e9t\u00e9") + self._ids(",") + self._ids("word"):
                self.ends = np.array([t.endswith(suffix) for t in self.token_at])
        # Words of letters in lower case need the model's merges alone, if it takes bytes; the rest of the tokenizer leaves them.
        self.merges = self.tokenizer
        if self.ends is None:
            return
        merges = Tokenizer(self.tokenizer.model)
        merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = " ".join(map(chr, filter(lambda c: chr(c).islower() and chr(c).isalpha(), range(ord(PLAIN)))))
        if all(merges.encode(probe).ids == self._ids(probe) for probe in (letters, letters.replace(" ", ""))):
            self.merges = merges

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _all(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(x)}I", *x) for x in (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))]

    def _learn_words(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words, encoding those that aren't known.

        Unknown words without marks to compose go in lower case, and closing punctuation behind a letter by itself, as
        the tokenizer treats them. Words of letters alone are one piece each, which ends with an end-of-word token, so
        many are encoded in one call and told apart by those.
        """
        if len(self.words) > self.cached_words:
            self.words, self.older = {}, self.words
        known, older, ready = self.words, self.older, self.ends is not None
        parts: dict[bytes, tuple[bytes, ...]] = {}
        letters, others = [], []
        for w in words.difference(known):
            if (ids := older.get(w)) is not None:
                known[w] = ids
            elif ready and w.isalpha() and w.islower():
                letters.append(w)
            else:
                parts[w] = self._parts(w)
        simple = set(letters)
        for p in set(chain.from_iterable(parts.values())).difference(known, simple):
            if (ids := older.get(p)) is not None:
                known[p] = ids
            elif ready and (p.isalpha() if p.isascii() else self._letters(p.decode())):
                letters.append(p)
            else:
                others.append(p)
        for a in range(0, len(letters), 2048):
            some = letters[a : a + 2048]
            ids = np.array(self.merges.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(some):
                raise ValueError("a word of letters isn't one piece in this tokenizer")
            whole = ids.tobytes()
            known.update(zip(some, (whole[x:y] for x, y in pairwise([0, *stops])), strict=True))
        for a in range(0, len(others), 2048):
            some = others[a : a + 2048]
            known.update(zip(some, self._all([p.decode() for p in some]), strict=True))
        for w, some in parts.items():
            if len(some) > 1 or some[0] != w:
                known[w] = b"".join(map(known.__getitem__, some))
        return known

    @staticmethod
    def _letters(s: str) -> bool:
        return s.isalpha() and max(s) < PLAIN and "\u0130" not in s

    def _parts(self, word: bytes) -> tuple[bytes, ...]:
        if self.ends is None or b"<|" in word:
            return (word,)
        if word.isascii():
            low = word.lower()
            stem = low.rstrip(CLOSING)
            return (stem, low[len(stem) :]) if len(stem) < len(low) and stem[-1:].isalpha() else (low,)
        s = word.decode()
        if max(s) >= PLAIN or "\u0130" in s:
            return (word,)
        s = s.lower()
        stem = s.rstrip(CLOSING.decode())
        return (stem.encode(), s[len(stem) :].encode()) if len(stem) < len(s) and stem[-1:].isalpha() else (s.encode(),)

    def _pieces(self, block: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of the words inside chunks, without the outer ones, of chunks of four words or more.

        Returns them as a dictionary array, the number of each piece's word, the number of each chunk's first word (and
        one more at the end) and where words start in the chunks, one space between them. Pieces are words, or parts of
        words where a letter meets punctuation, with A-Z lower-cased; words that may hold a special token or something
        that composes stay as they are.
        """
        buffer = np.frombuffer(b" ".join([*block, b""]), np.uint8)
        kind = KIND[buffer]
        space = kind == SPACE
        starts = ~space
        starts[1:] &= space[:-1]
        word_at, word_of = np.flatnonzero(starts), np.cumsum(starts, dtype=np.int32) - 1
        bounds = np.searchsorted(word_at, np.cumsum([0, *(len(c) + 1 for c in block)]))
        inner = np.repeat(np.diff(bounds) >= 4, np.diff(bounds))
        some = np.flatnonzero(np.diff(bounds))
        inner[bounds[some]] = inner[bounds[some + 1] - 1] = False
        marks = buffer >= NOT_PLAIN
        marks[:-1] |= (buffer[:-1] == ord("<")) & (buffer[1:] == ord("|"))
        loose = np.full(len(word_at), self.ends is not None)
        loose[word_of[marks]] = False
        kept = np.flatnonzero(~space)
        kept = kept[inner[word_of[kept]]]
        of, kinds = word_of[kept], kind[kept]
        cuts = kinds == PUNCTUATION
        cuts[1:] &= kinds[:-1] == LETTER
        cuts = cuts & loose[of] | starts[kept]
        data = np.where((kinds == LETTER) & loose[of], buffer[kept] | 32, buffer[kept])
        offsets = np.append(np.flatnonzero(cuts), len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return pieces.dictionary_encode(), of[cuts], bounds, word_at

    def _learn_chunks(self, chunks: set[bytes]) -> dict[bytes, tuple | None]:
        """Of each chunk (ids between its outer words, its head to the end of the first whole word, its tail from the last whole one, their ids); None if it has no whole words."""
        known = {c: found[0] for c in chunks if (found := self.chunks[c]) is not None}
        new = [c for c in chunks if c not in known]
        self.encoded_chunks += len(new)
        for a, b in slices([len(c) for c in new], BLOCK):
            block = new[a:b]
            pieces, piece_word, bounds, word_at = self._pieces(block)
            distinct = pieces.dictionary.to_pylist()
            ids_of = self._learn_words(set(distinct))
            found = [ids_of[p] for p in distinct]
            lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
            held, index = np.frombuffer(b"".join(found), "<u4"), pieces.indices.to_numpy()
            counts = lengths[index]
            ends = np.cumsum(counts)
            begins = (np.cumsum(lengths) - lengths)[index] - (ends - counts)
            whole = held[np.repeat(begins, counts) + np.arange(len(begins) and ends[-1])].tobytes()
            # Where each word's ids start: words without pieces here have none.
            at = 4 * np.concatenate([[0], np.cumsum(np.bincount(piece_word, counts, len(word_at)).astype(np.int64))])
            for k, c in enumerate(block):
                first, last = int(bounds[k]), int(bounds[k + 1])
                if last - first < 4:
                    made = None
                else:
                    x, x1, y1, y = at[[first, first + 2, last - 2, last]].tolist()
                    outer, right = c.split(None, 2), c.rsplit(None, 2)
                    head, tail = len(c) - len(outer[2]), len(right[0])
                    made = (whole[x:y], c[:head].rstrip(), c[tail:].lstrip(), whole[x:x1], whole[y1:y])
                known[c] = made
                self.chunks.add(c, made, 400 + 2 * len(c) + (len(made[0]) if made else 0))
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids."""
        cut = []
        for text in texts:
            starts = chunk_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), self.bits, self.least)
            cut.append([text[a:b].encode() for a, b in pairwise([*starts, len(text)])])
        known = self._learn_chunks({c for chunks in cut for c in chunks})
        plans = []  # of each text its stretches between whole chunks, and those
        for chunks in cut:
            solid = [k for k, c in enumerate(chunks) if known[c] is not None]
            joins = []
            for a, b in pairwise([-1, *solid, len(chunks)]):
                left = known[chunks[a]] if a >= 0 else None
                right = known[chunks[b]] if b < len(chunks) else None
                joins.append((left, right, (left[2] if left else b"") + b"".join(chunks[a + 1 : b]) + (right[1] if right else b"")))
            plans.append((joins, [known[chunks[k]] for k in solid]))
        fresh = list({w for joins, _ in plans for *_, w in joins})
        windows = dict(zip(fresh, (x for a in range(0, len(fresh), 4096) for x in self._all([w.decode() for w in fresh[a : a + 4096]])), strict=True))
        return [self._stitched(text, joins, solid, windows) for text, (joins, solid) in zip(texts, plans, strict=True)]

    def _stitched(self, text: str, joins: list, solid: list, windows: dict[bytes, bytes]) -> bytes:
        """Chunks and repaired joins in turn; a join must have the neighbours' ids at its ends, which then count once."""
        out = []
        for k, (left, right, window) in enumerate(joins):
            ids = windows[window]
            before, after = left[4] if left else b"", right[3] if right else b""
            if left and right and len(ids) < len(before) + len(after) or not ids.startswith(before) or not ids.endswith(after):
                self.widened += 1
                return self._widened(text)
            out.append(ids[len(before) : len(ids) - len(after)])
            if right:
                out.append(solid[k][0])
        return b"".join(out)

    def _widened(self, text: str) -> bytes:
        """The widest stretch: all of the text."""
        return self._all([text])[0]

    def decode(self, ids: bytes) -> str:
        """As the library decodes without skipping special tokens; without a decoder it puts a space between tokens."""
        return self.decoded([ids])[0].as_py()

    def decoded(self, ids: list[bytes]) -> pa.Array:
        if self.joined_by_space:
            return joined(self.tokens, ids)
        return pa.array([self.tokenizer.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in ids], pa.string())


def joined(names: pa.Array, ids: list[bytes]) -> pa.Array:
    """Of each text the names of its ids, one space between them."""
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(np.frombuffer(b"".join(ids), "<u4"))))
    return pc.binary_join(lists, " ")


_loaded: dict[tuple, Chunked] = {}


def encode_documents(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = (), decoded: bool = False, text_ids: bool = False, bits: int = 9, least: int = 128, chars: int = 1 << 19) -> DataFrame:
    """The columns `keep`, then n_tokens, ids (binary, little-endian unsigned 32-bit) and, if asked for, decoded (string) and decimal_ids (string, joined by spaces).

    tokenizer: path of a file of the tokenizers library whose tokens don't cross white space. Every whole text is
    encoded as that library does with add_special_tokens=False, special strings inside texts included; a null text is
    empty and has no ids. Rows are independent: repeated rows get equal ids, an empty table stays empty. Columns that
    aren't kept don't matter, whatever their names; a kept one with the name of a result is refused. bits, least: chunks
    have 2**bits code points besides `least` on average; they change no result.
    """
    made = ["n_tokens", "ids", *["decoded"] * decoded, *["decimal_ids"] * text_ids]
    if clash := set(keep) & set(made):
        raise ValueError(f"columns {sorted(clash)} are results; rename them before")
    bound_arrow(df.sparkSession)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema]
    schema = ", ".join([*kept, "n_tokens bigint", "ids binary", *["decoded string"] * decoded, *["decimal_ids string"] * text_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, bits, least)
        if key not in _loaded:
            _loaded[key] = Chunked(*key)
        model = _loaded[key]
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            ids, plain, decimal = [], [pa.array([], pa.string())], [pa.array([], pa.string())]
            for a, b in slices([len(t) for t in texts], chars):
                some = model.encode(texts[a:b])
                ids += some
                if decoded:
                    plain.append(model.decoded(some))
                if text_ids:
                    decimal.append(joined(model.decimals, some))
            columns = [batch.column(k) for k in range(len(keep))]
            columns += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.concat_arrays(plain))
            if text_ids:
                columns.append(pa.concat_arrays(decimal))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made])

    return df.select(*keep, df[text]).mapInArrow(run, schema)
