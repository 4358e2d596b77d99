"""Operator 3: secret scan.

Base kinds (contract): ``assign`` (a credential name, a separator, a value),
``access`` (AKIA keys), ``hex`` (long lower-case hex runs).  The method adds
kind ``entropy``: over each candidate string (a long run of key characters) a
window slides; its Shannon entropy per character class is kept up to date by
incremental counts, and windows above the class's threshold are joined to
spans.  An allow-list suppresses entropy spans only: candidates that are UUIDs,
paths or numbers as a whole, spans with a placeholder or a sequence in them, and what
lies in a base span.

Defined results: null text is empty; empty and clean texts give zero counts
and empty strings; repeated rows are scanned each on its own; columns of the
input that carry an output name are replaced.  Offsets are code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, bytes_of
from .words import spans

KINDS = ("assign", "access", "hex", "entropy")
# fixed values of the contract
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True
KEY = np.zeros(256, bool)
KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True

#: Window, and bits per character that each class of window has to reach.
WINDOW = 20
THRESHOLD = {"hex": 3.1, "alnum": 3.6, "base64": 3.8}
#: Harmless candidates as a whole: UUIDs, words joined by marks, numbers.
HARMLESS = [re.compile(p) for p in (
    r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    r"^[A-Za-z]+([-_/=+][A-Za-z]+)*$",
    r"^[0-9+/_=-]+$",
)]
#: Placeholders and sequences inside a span.
PLACEHOLDER = re.compile(
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test[_-]?key"
    r"|abcdefghij|0123456789|qwertyuiop")
PLOGP = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def char_class(digits: int, lower: int, upper: int, marks: int, beyond_hex: int) -> str:
    """Class of a window by the kinds of characters in it; '' if it can't be a key."""
    if not digits:
        return ""
    if not beyond_hex:
        return "hex" if lower or upper else ""
    if marks:
        return "base64" if lower and upper else ""
    return "alnum" if lower or upper else ""


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def entropy_spans(s: str) -> list[tuple[int, int]]:
    """Spans of ``s`` covered by windows whose entropy reaches their class's threshold."""
    out: list[tuple[int, int]] = []
    seen: dict[str, int] = {}
    kinds, beyond, total = [0, 0, 0, 0], 0, 0.0
    for i, c in enumerate(s):
        n = seen.get(c, 0)
        seen[c] = n + 1
        total += PLOGP[n + 1] - PLOGP[n]
        kinds[_kind(c)] += 1
        beyond += c not in "0123456789abcdefABCDEF"
        if i >= WINDOW - 1:
            name = char_class(*kinds, beyond)
            if name and math.log2(WINDOW) - total / WINDOW >= THRESHOLD[name] - 1e-9:
                start = i - WINDOW + 1
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((start, i + 1))
            c = s[i - WINDOW + 1]
            n = seen[c]
            seen[c] = n - 1
            total += PLOGP[n - 1] - PLOGP[n]
            kinds[_kind(c)] -= 1
            beyond -= c not in "0123456789abcdefABCDEF"
    return out


def allowed(s: str) -> bool:
    """Whether a candidate is harmless as a whole."""
    return any(p.search(s) for p in HARMLESS)


class Cover:
    """Spans of one text, asked whether one of them holds another span."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        spans = sorted((x, y) for x, _, y in spans)
        self.starts = [x for x, _ in spans]
        self.ends = list(accumulate((y for _, y in spans), max))

    def holds(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        return i > 0 and self.ends[i - 1] >= b


FIELDS = T.StructType([
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()), T.StructField("n_entropy", T.LongType()),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def _long_runs(data: np.ndarray, off: np.ndarray, member: np.ndarray, least: int):
    st, en, doc = spans(data, off, member)
    keep = np.flatnonzero(en - st >= least)
    return st[keep], en[keep], np.searchsorted(off, st[keep], side="right") - 1


def scan(arr: pa.Array) -> list[pa.Array]:
    data, off = bytes_of(arr)
    n = len(arr)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    raw = data.tobytes()
    lower = raw.lower()

    def holding(words, text) -> list[int]:
        at = []
        for w in words:
            p = text.find(w)
            while p >= 0:
                at.append(p)
                p = text.find(w, p + 1)
        return sorted(set((np.searchsorted(off, np.array(at, np.int64), side="right") - 1)
                          .tolist()))

    # code points before each byte: its continuation bytes start none
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int32))

    def place(d: int, byte: int) -> int:
        return int(points[byte] - points[off[d]])

    for d in holding(NAMES, lower):
        text = raw[off[d]:off[d + 1]].decode()
        found[d] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                     if m.end(2) - m.start(2) >= 12]
    for d in holding((b"AKIA",), raw):
        text = raw[off[d]:off[d + 1]].decode()
        found[d] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                     if m.end() - m.start() >= 18]
    if len(data):
        for x, y, d in zip(*(v.tolist() for v in _long_runs(data, off, HEX, 16))):
            start = place(d, x)
            found[d].append((start, 2, start + y - x))
        doc, base = -1, Cover([])
        for x, y, d in zip(*(v.tolist() for v in _long_runs(data, off, KEY, WINDOW))):
            if d != doc:  # runs come by document; none of its entropy spans is in yet
                doc, base = d, Cover(found[d])
            s, start = raw[x:y].decode(), place(d, x)
            if base.holds(start, start + y - x) or allowed(s):
                continue
            for a, b in entropy_spans(s):
                if not (base.holds(start + a, start + b) or PLACEHOLDER.search(s, a, b)):
                    found[d].append((start + a, 3, start + b))
    counts = np.zeros((4, n), np.int64)
    digests, joined = [], []
    for d, f in enumerate(found):
        f.sort()
        for _, k, _ in f:
            counts[k, d] += 1
        text = [f"{KINDS[k]}:{x}:{y}" for x, k, y in f]
        digests.append(hashlib.sha256(
            ",".join(t for t, (_, k, _) in zip(text, f) if k < 3).encode()).hexdigest())
        joined.append(",".join(text))
    return [pa.array(c) for c in counts] + [pa.array(digests, pa.string()),
                                            pa.array(joined, pa.string())]


def secret_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with counts per kind, base_sha256 and spans."""
    return append_columns(docs, text, scan, FIELDS, drop=(text,))
