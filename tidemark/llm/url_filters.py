"""URL rules judged by one bit-parallel automaton.

Every rule becomes glob patterns over the canonical URL (lower-cased host, then path). All patterns are packed into
64-bit words, one bit for each pattern state, and run together over each URL (Shift-And with wildcards): a step shifts
the state words, masks them by the character's class and adds the states that a wildcard holds. The URLs of a batch
advance together, so a step is a few numpy operations whatever the number of rules.

Globs: `?` is one character but `/`; `*` any run without `/`; `**` any run; a backslash takes the next character as it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, fresh


@dataclass(frozen=True)
class UrlRule:
    """Blocks or allows a host with its subdomains, below a path."""

    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        literal = "".join("\\" + c if c in "*?\\" else c for c in str(self))
        return [literal + "**", "*." + literal + "**"]


#: Fixed rules of the query op1.
RULES = (UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("example.com", "/de/", "block"), UrlRule("org", "/fr/", "allow"))


class GlobSet:
    """Glob patterns packed into Shift-And masks; `match` tells for each text which pattern fits the whole of it."""

    def __init__(self, globs: Sequence[str]):
        bits: list[tuple[str | None, str | None]] = []  # of each state: the character that leads to it, the wildcard that holds it
        starts, ends = [], []
        for glob in globs:
            starts.append(len(bits))
            bits.append((None, None))
            k = 0
            while k < len(glob):
                if glob[k] == "*":
                    hold = "**" if glob.startswith("**", k) or bits[-1][1] == "**" else "*"
                    bits[-1] = (bits[-1][0], hold)
                    k += 2 if glob.startswith("**", k) else 1
                    continue
                if glob[k] == "?":
                    bits.append(("?any", None))
                else:
                    k += glob[k] == "\\" and k + 1 < len(glob)
                    bits.append((glob[k], None))
                k += 1
            ends.append(len(bits) - 1)
        self.words = (len(bits) + 63) // 64 or 1
        self.alphabet = np.array(sorted({ord(c) for c, _ in bits if c and len(c) == 1} | {ord("/")}), dtype=np.uint32)
        n = len(self.alphabet) + 1  # the last class: characters that no pattern names
        self.enter, self.hold = np.zeros((n, self.words), np.uint64), np.zeros((n, self.words), np.uint64)
        for k, (char, held) in enumerate(bits):
            word, bit = divmod(k, 64)
            for c in range(n):
                code = int(self.alphabet[c]) if c < n - 1 else -1
                slash = code == ord("/")
                if char == "?any" and not slash or char and char != "?any" and ord(char) == code:
                    self.enter[c, word] |= np.uint64(1 << bit)
                if held == "**" or held == "*" and not slash:
                    self.hold[c, word] |= np.uint64(1 << bit)
        self.start = np.zeros(self.words, np.uint64)
        for k in starts:
            self.start[k // 64] |= np.uint64(1 << k % 64)
        self.ends = ends

    def match(self, texts: Sequence[str]) -> np.ndarray:
        """Booleans, a row for each text and a column for each pattern."""
        if not len(texts):
            return np.zeros((0, len(self.ends)), bool)
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        sorted_lengths = lengths[order]
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.alphabet, codes)
        at[at == len(self.alphabet)] = 0
        classes = np.where(self.alphabet[at] == codes, at, len(self.alphabet)) if len(codes) else at
        offsets = (np.cumsum(lengths) - lengths)[order]
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        active = np.searchsorted(-sorted_lengths, -np.arange(sorted_lengths[0]), side="left")  # texts longer than each step
        for step, k in enumerate(active):
            c, now = classes[offsets[:k] + step], state[:k]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[:k] = (shifted & self.enter[c]) | (now & self.hold[c])
        out = np.zeros((len(texts), len(self.ends)), bool)
        for k, end in enumerate(self.ends):
            out[order, k] = (state[:, end // 64] >> np.uint64(end % 64)) & one
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the end."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return ascii_lower(host), path


def judge_urls(df: DataFrame, rules: Sequence[UrlRule] = RULES, url: str = "url", default: str = "allow", chunk: int = 4096) -> DataFrame:
    """Adds host, path, rule and verdict to every row; the longest rule that fits decides, the first among equals, else `default`.

    A null URL or one without `://` has an empty host and path, so no rule fits it. Rows are independent: repeated rows
    get equal verdicts, an empty table stays empty. Columns of df named host, path, rule or verdict are replaced.
    """
    rules = list(rules)
    ranked = sorted(range(len(rules)), key=lambda k: (-len(str(rules[k])), k))
    owners = [k for k in ranked for _ in rules[k].globs()]
    automaton = GlobSet([g for k in ranked for g in rules[k].globs()])

    @F.pandas_udf("int")
    def best(host: pd.Series, path: pd.Series) -> pd.Series:
        texts = (host + path).tolist()
        found = np.full(len(texts), -1, np.int32)
        for k in range(0, len(texts), chunk):
            hits = automaton.match(texts[k : k + chunk])
            if hits.shape[1]:
                found[k : k + chunk] = np.where(hits.any(axis=1), np.array(owners)[hits.argmax(axis=1)], -1)
        return pd.Series(found)

    host, path = host_and_path(F.col(url))
    (at,) = fresh(df, "rule_number")
    pick = lambda values: F.when(F.col(at) >= 0, F.get(F.array(*[F.lit(v) for v in values] or [F.lit("")]), F.col(at)))
    out = df.withColumns({"host": host, "path": path}).withColumn(at, best("host", "path"))
    out = out.withColumns({"rule": pick([str(r) for r in rules]), "verdict": F.coalesce(pick([r.verdict for r in rules]), F.lit(default))})
    return out.drop(at)
