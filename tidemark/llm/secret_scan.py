"""Secrets in texts: fixed patterns, and a randomness test battery for what has no pattern.

A candidate is a long run of encoded-looking characters outside the patterns' spans. Its encoding (hex, base32, base64)
is inferred from its characters, and three tests ask whether it could be random in that alphabet: chi-squared
uniformity, runs about the alphabet's middle, and lag-1 serial correlation; Fisher's method combines them, and a
candidate that is plainly not random goes. Words aren't rejected by that when they are short. So false discoveries are
controlled where length matters: the null hypothesis is a natural text of the same length, for which the chi-squared
statistic is non-central with a parameter that grows with the length. The lower tail gives each candidate a p-value, and
the Benjamini-Hochberg procedure over the candidates of a text decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_arrow

KINDS = ("assign", "access", "hex", "random")
#: The patterns (fixed values); the letters of the first names match in either case, ASCII only.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")


@dataclass(frozen=True)
class Encoding:
    """excess: k * sum(q * q) - 1 for natural text, q being its frequencies of the k characters."""

    name: str
    alphabet: str
    excess: float


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: In order of inference: the first whose alphabet holds the candidate. Runs of digits alone are numbers, not secrets.
ENCODINGS = (
    Encoding("hex", _DIGITS + "abcdef", 0.6),
    Encoding("HEX", _DIGITS + "ABCDEF", 0.6),
    Encoding("base32", _UPPER + "234567", 1.1),
    Encoding("base64", _UPPER + _LOWER + _DIGITS + "+/", 3.2),
    Encoding("base64url", _UPPER + _LOWER + _DIGITS + "-_", 3.2),
)
_INDEX = [{c: k for k, c in enumerate(e.alphabet)} for e in ENCODINGS]


def upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_upper(x: float, k: int) -> float:
    """P(chi-squared with k degrees >= x), by Wilson and Hilferty."""
    return upper_normal(((x / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(2 / (9 * k)))


def noncentral_lower(x: float, k: int, shift: float) -> float:
    """P(non-central chi-squared <= x), by Sankaran."""
    a, b, c = k + shift, k + 2 * shift, k + 3 * shift
    h = 1 - 2 * a * c / (3 * b * b)
    p, m = b / (a * a), (h - 1) * (1 - 3 * h)
    z = ((x / a) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (h * math.sqrt(2 * p) * (1 + 0.5 * m * p))
    return 1 - upper_normal(z)


def battery(token: str) -> tuple[str, float, float] | None:
    """(encoding, p of randomness, p of natural text); None for no encoding, or digits or letters of one kind that repeat only."""
    body = token.rstrip("=")
    for encoding, index in zip(ENCODINGS, _INDEX, strict=True):
        if all(c in index for c in set(body)):
            break
    else:
        return None
    if body.isdigit():
        return None
    n, k = len(body), len(encoding.alphabet)
    values = np.array([index[c] for c in body], float)
    counts = np.bincount(values.astype(int), minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    high = values >= k / 2
    n1 = int(high.sum())
    n0 = n - n1
    if not n0 or not n1:
        runs_p = 2.0 ** (1 - n)
    else:
        mean = 2 * n0 * n1 / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs_p = 2 * upper_normal(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var))
    centred = values - values.mean()
    power = float((centred**2).sum())
    serial_p = 2 * upper_normal(abs(float((centred[1:] * centred[:-1]).sum())) / power * math.sqrt(n)) if power else 0.0
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (chi2_upper(chi, k - 1), min(runs_p, 1.0), min(serial_p, 1.0)))
    return encoding.name, chi2_upper(fisher, 6), noncentral_lower(chi, k - 1, n * encoding.excess)


def find_secrets(text: str, alpha: float = 0.001, fdr: float = 0.01) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS; code points, end exclusive."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    taken = sorted((a, b) for _, a, b in spans)
    tested, k = [], 0
    for m in CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        if found := battery(m[0]):
            tested.append((found[2], found[1], m.span()))
    tested.sort()
    passed = max((k for k, (p, _, _) in enumerate(tested, 1) if p <= fdr * k / len(tested)), default=0)
    spans += [("random", *span) for _, randomness, span in tested[:passed] if randomness >= alpha]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), alpha: float = 0.001, fdr: float = 0.01) -> DataFrame:
    """The columns `keep`, then secrets: an array of (kind, start, end), a row for each row of df.

    A null or empty text has none. A text is judged on its own, whole, so repeated rows get equal spans and an empty
    table stays empty; columns that aren't kept don't matter, whatever their names.
    """
    bound_arrow(df.sparkSession)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema]
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_secrets(t or "", alpha, fdr)] for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(found, pa.list_(span))], names=[*keep, "secrets"])

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, ", ".join([*kept, "secrets array<struct<kind:string,start:int,end:int>>"]))


def spans_string(secrets: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
