"""Operator 5, secret scans: base patterns and a token-efficiency test.

The base patterns are key assignments, access keys and long hex strings. The
method looks at every run of key characters outside them: a tokenizer's vocabulary is
made of frequent strings, so text takes few tokens for its characters and random strings
take many. A run of MIN_CHARS or more that has
less than RATIO characters to a token is a secret, whatever stands before it. So is a
part of it after an equals sign. What is left of a run
outside the base patterns is a run again, and so is what is left outside known digests
(hex in the length of a common hash) and UUIDs. A url's path is no run as a whole: its host and each segment between slashes
are runs of their own. Names of mail addresses are runs like any other. Numbers, dates and
times, that is runs without a letter, are never secrets.

Everything happens in one pass over the rows, with no exchange. Places are code points, ends
exclusive, in the whole text.

Defined cases: null text is empty; runs of any length are matched whole; repeated rows give equal
results; extra columns are ignored; an empty table gives an empty result. Spans of
different kinds may overlap; redaction merges them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import renewed, slices, vocabulary, whole

#: Fixed values of the base patterns, in their order.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

MIN_CHARS, RATIO = 20, 2.0
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
DIGESTS = (32, 40, 56, 64, 96, 128)
NUMBER = re.compile(r"[0-9+/_=-]+")
#: Digests and UUIDs that stand alone; host and path of urls.
KNOWN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|%s)(?![0-9A-Za-z])" % "|".join("[0-9a-fA-F]{%d}" % n for n in DIGESTS))
ADDRESS = re.compile(r"""://(?:[^\s/?#@"'<>]*@)?(?P<url>[^\s?#"'<>]*)""")
PART = re.compile(r"=+(?=[^=])")
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by place and kind."""
    low = text.lower() if text.isascii() else None
    out = []
    if low is None or any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(2, *m.span()) for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def tokens(text: str) -> int:
    """Tokens of a run in the byte-level vocabulary."""
    return len(vocabulary().encode_ordinary(text))


def is_random(run: str) -> bool:
    """Whether a run of key characters looks like a random string and is no known kind of identifier."""
    if NUMBER.fullmatch(run) or KNOWN.fullmatch(run):
        return False
    return len(run) < RATIO * tokens(run)


def _outside(start: int, end: int, taken: list[tuple[int, int]], at: int) -> Iterator[tuple[int, int]]:
    """The stretches of MIN_CHARS or more between start and end that are in none of the taken ones from place at on; these are sorted."""
    while at < len(taken) and taken[at][0] < end:
        i, j = taken[at]
        at += 1
        if j > start:
            if i - start >= MIN_CHARS:
                yield start, i
            start = j
    if end - start >= MIN_CHARS:
        yield start, end


def _random_parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The whole stretch if it is random, else those of its parts between equals signs that are."""
    if is_random(text[start:end]):
        return [(start, end)]
    cuts = [start, *(m.end() for m in PART.finditer(text, start, end)), end]
    return [(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j - i >= MIN_CHARS and is_random(text[i:j])] if len(cuts) > 2 else []


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i, j in sorted(spans):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]))
        else:
            out.append((i, j))
    return out


def all_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans, and random strings outside them, by place and kind."""
    out = base_spans(text)
    runs = [m.span() for m in RUN.finditer(text)]
    if not runs:
        return out
    taken = [(i, j) for _, i, j in out] + [m.span() for m in KNOWN.finditer(text)]
    if "://" in text:
        taken += [(at, at + 1) for m in ADDRESS.finditer(text) for at in range(*m.span("url")) if text[at] == "/"]
    taken = _merged(taken)
    at = 0
    for i, j in runs:
        while at < len(taken) and taken[at][1] <= i:
            at += 1
        for a, b in _outside(i, j, taken, at):
            out += [(3, *p) for p in _random_parts(text, a, b)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for k, i, j in spans)


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with each stretch of spans replaced by a mark."""
    out, at = [], 0
    for _, i, j in spans:
        if i >= at:
            out += [text[at:i], mark]
        at = max(at, j)
    return "".join(out) + text[at:] if spans else text


def _scan(redacted: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [all_spans(t) for t in texts]
            if redacted:
                new = [t if not s else redact(t, s) for t, s in zip(batch.column("text").to_pylist(), found, strict=True)]
                yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
                continue
            counts = [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in range(len(KINDS))]
            base = [_joined(s for s in f if s[0] < 3) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array(list(map(_joined, found)), pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"],
            )

    return scan


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_spans and spans for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(False), f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret replaced by a mark; n_chars follows the text."""
    rows = whole(docs).select(F.col("_row").dropFields("text").alias("_row"), F.col("_row")["text"].alias("text"))
    return renewed(docs, rows.mapInArrow(_scan(True), rows.schema))
