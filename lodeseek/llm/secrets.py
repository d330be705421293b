"""Secret scans: fixed patterns and sliding-window entropy.

``scan`` reads whole texts as UTF-8 bytes. Fixed patterns give the base spans
(kinds ``assign``, ``access``, ``hex``). Beside them, every run of at least
``WINDOW`` token characters with digits and letters is a candidate string: a
window slides over it, character counts are updated by the byte that leaves
and the byte that enters, and windows whose Shannon entropy reaches the bound
of their character class (hexadecimal, one-case, mixed-case) are joined to
spans of kind ``entropy``. Windows that overlap a base span or a match of the
allow-list are left out, the rest of the string is kept; what stands before
the string may explain all of it.

All of it is computed within a row, so nothing is shuffled. Offsets are code
points, ends exclusive.

Edge cases. Null texts are empty and have no spans. Rows that repeat an id are
scanned one by one. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K

#: Fixed patterns (over UTF-8 bytes; letters of the words in either case, ASCII only).
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Bits a character, of at most log2(20) = 4.32, from which a window of a class is random.
HEX_BITS, CASE_BITS, MIXED_BITS = 3.0, 3.6, 3.8
#: Strings that look random but name or number public things.
ALLOWED = (
    re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(
        rb"(?i)sha(?:"
        + b"|".join(
            b"%d[-:=]?(?:(?:[0-9a-f]{%d}|[a-z0-9+/_-]{%d}={0,2})(?![a-z0-9+/_=-]))?" % (bits, size * 2, -(-size * 4 // 3)) for bits, size in ((1, 20), (224, 28), (256, 32), (384, 48), (512, 64))
        )
        + rb")"
    ),
    re.compile(rb"(?i)example|dummy|placeholder|changeme|sample|redacted"),
    re.compile(rb"(?i)0123456789|1234567890|abcdefghij|qwerty"),
    re.compile(rb"(.{1,4}?)\1{4,}"),
    re.compile(rb"^[0-9]+([-/_=.+][0-9]+)*$"),
    re.compile(rb"^([a-zA-Z]+|[0-9]{1,8})([-/_=.+]+([a-zA-Z]+|[0-9]{1,8}))+$"),
)
#: What may stand in the unbroken string before a candidate and explain it, and the bytes that break strings.
BEFORE = tuple(re.compile(p, re.I) for p in (rb"https?:", rb"www\.", rb"[a-z0-9-]\.(?:com|org|net)", rb"data:[a-z/+.-]+;base64,"))
BREAKS = b" \t\n\x0b\x0c\r\"'<>"

_is = lambda chars: np.isin(np.arange(256), list(chars))
HEX, DIGIT = _is(b"0123456789abcdef"), _is(b"0123456789")
LETTER = _is(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
TOKEN = HEX | LETTER | _is(b"+/=_-")
BREAK = _is(BREAKS)
_CLOGC = [0.0] + [c * log2(c) for c in range(1, WINDOW + 2)]


def entropy_windows(s: bytes, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of ``s`` covered by windows whose entropy reaches the bound of their class."""
    if len(s) < window:
        return []
    count, total, classes = [0] * 256, 0.0, [0, 0, 0, 0]  # digits, lower, upper, letters beyond f

    def put(b: int, by: int) -> None:
        nonlocal total
        total -= _CLOGC[count[b]]
        count[b] += by
        total += _CLOGC[count[b]]
        if 48 <= b <= 57:
            classes[0] += by
        elif 97 <= b <= 122:
            classes[1] += by
        elif 65 <= b <= 90:
            classes[2] += by
        if 103 <= b <= 122 or 71 <= b <= 90 or b in b"+/=_-":
            classes[3] += by

    for b in s[:window]:
        put(b, 1)
    out: list[tuple[int, int]] = []
    top = log2(window)
    for at in range(len(s) - window + 1):
        if at:
            put(s[at - 1], -1)
            put(s[at + window - 1], 1)
        digits, lower, upper, beyond = classes
        if digits < 2 or lower + upper < 2:
            continue
        bound = HEX_BITS if not beyond and not (lower and upper) else MIXED_BITS if lower and upper else CASE_BITS
        if top - total / window >= bound:
            if out and at <= out[-1][1]:
                out[-1] = (out[-1][0], at + window)
            else:
                out.append((at, at + window))
    return out


def unexplained(s: bytes, base: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of ``s`` between its base spans and the matches of the allow-list."""
    at = 0
    for a, b in sorted([*base, *(m.span() for p in ALLOWED for m in p.finditer(s))]):
        if a > at:
            yield at, a
        at = max(at, b)
    if at < len(s):
        yield at, len(s)


def _runs(mask: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least ``least`` bytes that don't cross texts."""
    at = offs[:-1][offs[:-1] < offs[1:]]
    prev, nxt = np.zeros_like(mask), np.zeros_like(mask)
    prev[1:], nxt[:-1] = mask[:-1], mask[1:]
    prev[at], nxt[at[1:] - 1] = False, False
    s, e = np.flatnonzero(mask & ~prev), np.flatnonzero(mask & ~nxt) + 1
    long = e - s >= least
    return s[long], e[long]


def find(texts: pa.Array) -> Iterator[list[tuple[int, int, int]]]:
    """For each text its spans (start, kind index, end) in code points, sorted."""
    for _, _, buf, offs in K.blocks(texts):
        n = len(offs) - 1
        found: dict[int, list[tuple[int, int, int]]] = {}
        data = buf.tobytes()
        doc = lambda p: int(np.searchsorted(offs, p, side="right")) - 1
        low, with_words, with_access = K.LOWER[buf].tobytes(), set(), set()
        for word in WORDS:
            at = low.find(word)
            while at >= 0:
                d = doc(at)
                with_words.add(d)
                at = low.find(word, int(offs[d + 1]))
        at = data.find(b"AKIA")
        while at >= 0:
            d = doc(at)
            with_access.add(d)
            at = data.find(b"AKIA", int(offs[d + 1]))
        for d in with_words:
            t = data[offs[d] : offs[d + 1]]
            found.setdefault(d, []).extend((m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 6)
        for d in with_access:
            t = data[offs[d] : offs[d + 1]]
            found.setdefault(d, []).extend((m.start(), 1, m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 20)
        for s, e in zip(*_runs(HEX[buf], offs, 24), strict=True):
            d = doc(s)
            found.setdefault(d, []).append((int(s - offs[d]), 2, int(e - offs[d])))
        s, e = _runs(TOKEN[buf], offs, WINDOW)
        if len(s):
            digits, letters = np.concatenate([[0], np.cumsum(DIGIT[buf])]), np.concatenate([[0], np.cumsum(LETTER[buf])])
            pick = (digits[e] - digits[s] >= 2) & (letters[e] - letters[s] >= 2)
            breaks = np.flatnonzero(BREAK[buf])
            explained: dict[int, int] = {}  # unbroken string -> where its first explanation ends
            for a, b in zip(s[pick].tolist(), e[pick].tolist(), strict=True):
                d = doc(a)
                o = int(offs[d])
                k = int(np.searchsorted(breaks, a))
                begin, end = max(o, int(breaks[k - 1]) + 1 if k else 0), min(int(offs[d + 1]), int(breaks[k]) if k < len(breaks) else len(data))
                if begin not in explained:
                    explained[begin] = min((m.end() for p in BEFORE if (m := p.search(data, begin, end))), default=len(data) + 1)
                if explained[begin] <= a:
                    continue
                base = [(x[0] - (a - o), x[2] - (a - o)) for x in found.get(d, []) if x[1] < 3 and x[0] < b - o and a - o < x[2]]
                for u, v in unexplained(data[a:b], base):
                    found.setdefault(d, []).extend((a - o + u + x, 3, a - o + u + y) for x, y in entropy_windows(data[a + u : a + v]))
        for d in range(n):
            spans = found.get(d)
            if not spans:
                yield []
                continue
            t = buf[offs[d] : offs[d + 1]]
            if (t >= 0x80).any():
                cp = np.concatenate([[0], np.cumsum((t & 0xC0) != 0x80)])
                spans = [(int(cp[a]), k, int(cp[b])) for a, k, b in spans]
            yield sorted(spans)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sha, all_ = [[], [], [], []], [], []
            for spans in find(b.column("text")):
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in spans))
                sha.append(hashlib.sha256(digest([x for x in spans if x[1] < 3]).encode()).hexdigest())
                all_.append(digest(spans))
            cols = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(sha, pa.string()), pa.array(all_, pa.string()), pa.array(counts[3], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span of its ``text`` replaced by ``mark``; all other columns are unchanged. Null texts stay null."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(at), []
            for t, spans in zip(texts, find(texts), strict=True):
                t = t.as_py()
                if spans:
                    parts, end = [], 0
                    for a, _, z in spans:
                        if a >= end:
                            parts += [t[end:a], mark]
                        end = max(end, z)
                    t = "".join(parts) + t[end:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, texts.type) if k == at else b.column(k) for k in range(b.num_columns)], b.schema.names)

    return docs.mapInArrow(run, schema)
