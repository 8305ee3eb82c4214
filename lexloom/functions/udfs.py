"""The three text functions that need an alignment; Arrow batches, one row's work bounded by its own texts."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from itertools import repeat
from operator import contains

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells, of one bit each, up to which an alignment keeps its whole table; larger ones are halved first.
CELLS = 1 << 26
#: Types, not their names: a name is parsed by a session, and this module is imported before there is one.
OPERATIONS = T.ArrayType(T.StructType([T.StructField("t", T.StringType()), T.StructField("s", T.StringType())]))


def _rows(old: str, new: str) -> list[int]:
    """Row k has a zero bit at place p where a longest common subsequence of old[:k] grows with new[p], all from the left; bit-parallel."""
    masks: dict[str, int] = {}
    for p, c in enumerate(new):
        masks[c] = masks.get(c, 0) | (1 << p)
    full = (1 << len(new)) - 1
    out = [full]
    for c in old:
        v, m = out[-1], masks.get(c, 0)
        out.append(((v + (v & m)) | (v & ~m)) & full)
    return out


def _grown(old: str, new: str) -> np.ndarray:
    """How long a common subsequence of old and each beginning of new may be."""
    masks: dict[str, int] = {}
    for p, c in enumerate(new):
        masks[c] = masks.get(c, 0) | (1 << p)
    full = v = (1 << len(new)) - 1
    for c in old:
        m = masks.get(c, 0)
        v = ((v + (v & m)) | (v & ~m)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(new) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(new)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _steps(old: str, new: str) -> list[tuple[str, str]]:
    """Single-character operations along a longest common subsequence; removals first where either would do."""
    n, m = len(old), len(new)
    if n > 1 and n * m > CELLS:
        half = n // 2
        at = int((_grown(old[:half], new) + _grown(old[half:][::-1], new[::-1])[::-1]).argmax())
        return _steps(old[:half], new[:at]) + _steps(old[half:], new[at:])
    rows = _rows(old[::-1], new[::-1])

    def best(i: int, j: int) -> int:
        """Of old[i:] and new[j:]."""
        return m - j - (rows[n - i] & ((1 << (m - j)) - 1)).bit_count()

    out, i, j = [], 0, 0
    while i < n and j < m:
        if old[i] == new[j]:
            out.append(("=", old[i]))
            i, j = i + 1, j + 1
        elif best(i + 1, j) >= best(i, j + 1):
            out.append(("-", old[i]))
            i += 1
        else:
            out.append(("+", new[j]))
            j += 1
    return out + [("-", c) for c in old[i:]] + [("+", c) for c in new[j:]]


def align(old: str, new: str) -> list[tuple[str, str]]:
    """Operations ('=', '-', '+') in text order along a longest common subsequence; neighbours of one kind are merged, removals come first.

    The common beginning stands apart; what follows takes a bit for each pair of
    characters at most, and of very long texts the halves are aligned on their own.
    """
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    out: list[tuple[str, str]] = []
    gone, come, same = [], [], [old[:head]]

    def flush() -> None:
        for kind, parts in (("=", same), ("-", gone), ("+", come)):
            if any(parts):
                out.append((kind, "".join(parts)))
            parts.clear()

    for kind, c in _steps(old[head:], new[head:]):
        if kind == "=" and (gone or come):
            flush()
        (same if kind == "=" else gone if kind == "-" else come).append(c)
    flush()
    return out


@F.pandas_udf(OPERATIONS)
def char_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"t": t, "s": s} for t, s in align(a or "", b or "")] for a, b in zip(old, new, strict=True)])


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def common_fragment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The longest substring that all texts of an array share, leftmost in the first."""
    for lists in batches:
        yield lists.map(lambda texts: longest_shared([t for t in texts if t is not None]))


_BASE, _UNBASE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


def _windows(sums: np.ndarray, down: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` characters."""
    n = len(sums) - size
    return (sums[size:] - sums[:n]) * down[:n]


#: Characters of a list's longest text up to which its windows are compared as texts.
SHORT = 256


def _shared_of_short(first: str, others: list[str]) -> str:
    low, high, found = 1, min([len(first), *map(len, others)]), first if not others else ""
    while others and low <= high:
        size = (low + high) // 2
        hit = next((w for k in range(len(first) - size + 1) if all(map(contains, others, repeat(w := first[k : k + size])))), None)
        if hit is None:
            high = size - 1
        else:
            found, low = hit, size + 1
    return found


def longest_shared(texts: list[str]) -> str:
    """Windows of one size are compared by hashes, a candidate then as text; memory in proportion to the texts. Short texts are compared as they are, each different one once."""
    if not texts:
        return ""
    if max(map(len, texts)) <= SHORT:
        return _shared_of_short(texts[0], [t for t in sorted(set(texts), key=lambda t: (len(t), t)) if t != texts[0]])
    longest = max(map(len, texts))
    up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, np.uint64(b))]), dtype=np.uint64) for b in (_BASE, _UNBASE))
    sums = []
    for t in texts:
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(t)], dtype=np.uint64)]))
    first, low, high, found = texts[0], 1, min(map(len, texts)), ""
    while low <= high:
        size = (low + high) // 2
        own = _windows(sums[0], down, size)
        shared = np.ones(len(own), bool)
        for s in sums[1:]:
            shared &= np.isin(own, _windows(s, down, size))
        hit = next((first[k : k + size] for k in np.flatnonzero(shared).tolist() if all(first[k : k + size] in t for t in texts[1:])), None)
        if hit is None:
            high = size - 1
        else:
            found, low = hit, size + 1
    return found
