"""Operators 11 to 13 against brute force, SQL and the tokenizer library, and their edges."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
from collections import Counter
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers, trainers

from tidemark.llm import chunked_bpe, importance_resampling, prefix_trie, queries
from tidemark.llm.common import running_total

SF = "/root/testdata/sf0.001"
WORD_BPE = queries.tokenizer_path("word_bpe_49k.json")


def test_running_total_over_ranges(spark):
    """A key of most rows is spread over ranges, and its sum goes on through them."""
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 8, 7).otherwise(F.col("id") % 10).cast("long").alias("k"), (F.col("id") * 37 % 3000).alias("at"), (F.col("id") % 5).alias("v"), F.lit("x").alias("part"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for key in ("k", None):
            seen, state = 0, Counter()
            for r in sorted(running_total(df, key, [F.col("at")], F.col("v"), "total").collect(), key=lambda r: r["at"]):
                state[r.k if key else 0] += r.v
                assert r.total == state[r.k if key else 0] and r.part == "x"
                seen += 1
            assert seen == 3000
        assert running_total(df.limit(0), "k", [F.col("at")], F.col("v"), "total").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ---- op11


def brute_trie(said: list[tuple]) -> set[tuple]:
    """said: (conv_id, turn, role, text)."""
    turns: dict = {}
    for c, turn, role, text in said:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append(((turn is not None, turn or 0, digest[:32]), (role, text)))
    turns = {c: [t for _, t in sorted(x)] for c, x in turns.items()}
    made = {}
    for c in turns:
        h = crc32(str(c).encode()) % 9
        made[c] = [*turns.get(c - int(math.fmod(c, 5)), [])[:h], *turns[c][h:]]
    members: dict = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = set()
    for key, m in members.items():
        below = [k for k in members if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(made[c]) == len(key)))
        out.add((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SAID = "conv_id long, turn long, role string, text string, rep int, depth string, n int, part long"


def trie_of(spark, said, **how):
    df = spark.createDataFrame([(*x, 1, "d", 2, 3) for x in said], SAID)
    got = prefix_trie.conversation_trie(df, **how)
    found = [tuple(r[c] for c in COLUMNS) for r in got.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_trie_by_hand(spark):
    rng = random.Random(11)
    said = []
    for c in [*range(-7, 40), 4000000000]:
        n = rng.choice([1, 1, 2, 3, 5, 9, 12])
        words = [rng.choice(["yes", "no", "é", None, ""]) for _ in range(n)]
        said += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "user", None]), w) for t, w in enumerate(words)]
    said += [(c, t, "user", "same") for c in range(100, 112) for t in range(6)]  # copies
    said += [(c, t, "user", f"t{t}" if t < 13 or c == 115 else "other") for c in (115, 120, 125) for t in range(15)]  # deep prefixes
    said += [(None, 0, "user", "nobody's"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (3, 0, "system", "tie")]
    want = brute_trie(said)
    for block in (1, 4, 8):
        assert trie_of(spark, said, block=block) == want


def test_trie_edges(spark):
    none = prefix_trie.conversation_trie(spark.createDataFrame([], SAID))
    assert none.count() == 0 and none.columns == list(COLUMNS)
    assert trie_of(spark, [(None, 1, "a", "b")]) == set()
    for said in ([(1, 1, "a", "b")], [(c, 1, None, None) for c in range(12)], [(0, k, "u", "x" * 200_000) for k in range(3)] + [(5, 0, "u", "x" * 200_000)]):
        assert trie_of(spark, said) == brute_trie(said)


def test_ids_are_digested_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    df = spark.range(2000).select((F.col("id") % 3).alias("rep"), F.col("id").alias("conv_id"))
    got = {r.rep: r.ends for r in prefix_trie.digest_ids(df).collect()}
    assert got == {k: hashlib.sha256(",".join(str(x) for x in range(k, 2000, 3)).encode()).hexdigest() for k in range(3)}


# ---- op12


def test_resampling_by_hand(spark):
    texts = ["the cat sat " * 9, "The CAT-sat; über 12 é" * 5, "dog " * 30, None, "", "one two", "cat " * 5000] + [f"word{k % 7} cat dog sat the " * (4 + k % 3) for k in range(40)]
    docs = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(0, texts[0], "x", 1), (None, texts[0], "x", 1)]
    target = [("the cat",), (None,), ("sat 12",)]
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for longest in (1, 2):
        runs = lambda t: [" ".join(w[k : k + n]) for w in [words(t)] for n in range(1, longest + 1) for k in range(len(w) - n + 1)]  # noqa: B023, E731
        bucket = lambda f: crc32(f.encode()) % 100
        s, t = Counter(bucket(f) for _, x, *_ in docs for f in runs(x)), Counter(bucket(f) for (x,) in target for f in runs(x))
        gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 100) / ((s[b] + 1) * (t.total() + 100))))  # noqa: B023, E731
        want = []
        for d, x, *_ in docs:
            h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
            weight = sum(gain(bucket(f)) for f in runs(x))
            want.append((d, len(runs(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x))))
        able = sorted((w for w in want if w[4] >= 20), key=lambda w: (-w[3], -1 if w[0] is None else w[0]))
        drawn = able[: len(able) * 10 // 100]
        ranks = {(w[0], w[3]): k + 1 for k, w in enumerate(drawn)}
        df = spark.createDataFrame(docs, "doc_id long, text string, score string, rank int")
        got = importance_resampling.resample(df, spark.createDataFrame(target, "text string"), buckets=100, longest=longest)
        assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
        key = lambda r: tuple(-1 if x is None else x for x in r)
        assert sorted(map(tuple, got.drop("rank").collect()), key=key) == sorted((w[:4] for w in want), key=key)
        assert {(r.doc_id, r.score): r["rank"] for r in got.where("rank is not null").collect()} == ranks and len(drawn) > 2
    empty = importance_resampling.resample(df.limit(0), df.limit(0))
    assert empty.count() == 0


def test_csr_rows_are_sparse_and_sorted():
    pointers, indices, counts = importance_resampling.csr([Counter(), Counter({b"a": 2, b"b": 1}), Counter({b"a": 5})], 3)
    assert pointers.tolist() == [0, 0, 2, 3] or crc32(b"a") % 3 == crc32(b"b") % 3
    assert counts.sum() == 8 and list(indices[:2]) == sorted(indices[:2])


# ---- op13


def library(texts):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    found = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    return found, [tokenizer.decode(ids, skip_special_tokens=False) for ids in found]


def test_chunks_give_the_librarys_ids():
    rng = random.Random(13)
    alphabet = [*"abcXYZ '12.,!ȩ́̇̌İßJFΣ日本각 \n\t\x0b\x0c\r\x1c\x85\xa0​<|>éÉª", "<|endoftext|>", "<|startoftext|>", " 're", "'LL ", "\U0001f600"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 40, 300, 900]))) for _ in range(600)]
    texts += ["no" * 5000, "日本" * 2000, "a b " * 3000, "<|endoftext|>" * 300, " " * 3000, texts[-1], texts[-1]]
    want, decoded = library(texts)
    for bits, least in ((2, 17), (5, 30), (9, 128)):
        model = chunked_bpe.Chunked(WORD_BPE, bits, least)
        got = [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in model.encode(texts)]
        assert got == want and [model.decode(struct.pack(f"<{len(x)}I", *x)) for x in got] == decoded


def test_chunks_follow_the_content_and_are_encoded_once():
    rng = random.Random(14)
    shared = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000))
    model = chunked_bpe.Chunked(WORD_BPE, 6, 32)
    first = model.encode([shared])
    before = model.encoded_chunks
    got = model.encode(["moved by this: " + shared, shared])
    assert got[1] == first[0] and model.encoded_chunks - before <= 3 < before
    assert model.widened == 0


def test_joins_that_disagree_are_widened(monkeypatch):
    model = chunked_bpe.Chunked(WORD_BPE, 5, 30)
    text = " ".join(f"word{k} or so," for k in range(300))
    want, _ = library([text])
    real = model._learn_words
    monkeypatch.setattr(model, "_learn_words", lambda words: {w: b"\0\0\0\0" if w == b"word150" else x for w, x in real(words).items()} | {b"or": b"\1\0\0\0"})
    got = model.encode([text])[0]
    assert model.widened == 1 and list(struct.unpack(f"<{len(got) // 4}I", got)) == want[0]


def test_words_are_learnt_by_pieces():
    rng = random.Random(15)
    stems = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    words = [f"{form(w)}{end}" for w in stems for form in (str, str.upper, str.title) for end in ("", ".", "***", '%,"', "!)-")]
    rng.shuffle(words)
    model = chunked_bpe.Chunked(WORD_BPE)
    text = " ".join(words)
    got = model.encode([text])[0]
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library([text])[0][0]
    assert len(model.words) <= len(set(stems)) + 4  # each stem and each ending once, in whatever case and company


def test_a_tokenizer_that_keeps_letters_and_punctuation_together(tmp_path):
    own = Tokenizer(models.BPE(end_of_word_suffix="</w>"))
    own.normalizer, own.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.Whitespace()
    texts = [f"one_two, One_Two{k}. two_one, word_{k}! \u00e9t\u00e9 one two" for k in range(30)]
    own.train_from_iterator(texts, trainers.BpeTrainer(end_of_word_suffix="</w>", show_progress=False))
    own.save(str(tmp_path / "own.json"))
    model = chunked_bpe.Chunked(str(tmp_path / "own.json"), 5, 30)
    got = [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in model.encode([" ".join(texts), *texts])]
    assert got == [own.encode(t, add_special_tokens=False).ids for t in (" ".join(texts), *texts)]


def test_pieces_of_odd_words_give_the_librarys_ids():
    odd = ["A<|endoftext|>B", "<|ENDOFTEXT|>", "x.<|startoftext|>.Y", "H\u0331h\u0331", "I\u0307.", "\u0130A.", "K\u0327,B", "DON'T", "x'st", "'Re'", "a.'ll", "\u00c9.A", "\u1e96H.", "\u03a3A\u03a3.", "A=\u0338", "a\x1cB.", "9.A", "A\x00B!", "\ufb01X."]
    model = chunked_bpe.Chunked(WORD_BPE, 9, 128)
    texts = [f"Some words, before {w} and (after) it." for w in odd] + [" ".join(odd), "\n".join(odd * 40), " \t".join(w + w for w in odd)]
    want, decoded = library(texts)
    got = [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in model.encode(texts)]
    assert got == want and model.decoded(model.encode(texts)).to_pylist() == decoded


def test_tokenizers_that_keep_spaces_are_refused():
    with pytest.raises(ValueError, match="white space"):
        chunked_bpe.Chunked(queries.tokenizer_path("byte_bpe_50k.json"))


def test_word_bpe_query_and_edges(spark):
    texts = duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall()
    ids, decoded = library([t for _, t in texts])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {tuple(r) for r in queries.op13_chunked_bpe(spark, SF).collect()}
    assert got == {(d, len(i), sha(" ".join(map(str, i))), sha(x)) for (d, _), i, x in zip(texts, ids, decoded, strict=True)}
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "Twice twice", 5), (3, "Twice twice", 5), (None, "a", 5), (4, "long " * 100_000, 5)], "doc_id long, text string, ids int")
    out = chunked_bpe.encode_documents(df, WORD_BPE, keep=("doc_id",)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2), (4, 100_000)]
    assert chunked_bpe.encode_documents(df.limit(0), WORD_BPE, keep=("doc_id",)).count() == 0
    with pytest.raises(ValueError, match="rename"):
        chunked_bpe.encode_documents(df, WORD_BPE, keep=("ids",))
