"""Text encodings and normalisation, as Arrow-batched functions: neither is a Spark function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
BOMS = (("0000feff", "utf-32-be"), ("fffe0000", "utf-32-le"), ("efbbbf", "utf-8-sig"), ("feff", "utf-16-be"), ("fffe", "utf-16-le"))
STRICT = ("utf-8", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be")
MARKS = tuple((bytes.fromhex(mark), name) for mark, name in BOMS)
SPACES = dict.fromkeys(map(ord, "\r\n\t"))
INVISIBLE = dict.fromkeys(map(ord, "​‌‍﻿"))
# --- end of fixed values ---
_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|([nrt]))")


def printable_ratio(text: str) -> float:
    if text.translate(SPACES).isprintable():
        return 1.0
    return sum(c.isprintable() or c in "\r\n\t" for c in text) / len(text)


def infer(data: bytes) -> tuple[str, float, str, str]:
    """(encoding, confidence, text, source): byte-order marks, then strict decodings and a statistical guess, by score."""
    for mark, name in MARKS:
        if data.startswith(mark):
            try:
                text = data.decode(name)
            except UnicodeError:
                break
            return name, min(1.0, 0.85 + 0.15 * printable_ratio(text)), text, "bom"
    found = []
    for name in STRICT:
        try:
            text = data.decode(name)
        except UnicodeError:
            continue
        nul = min(0.35, text.count("\0") / max(1, len(text)))
        found.append((0.55 + 0.40 * printable_ratio(text) - nul, name == "utf-8", name, text, "strict-candidate"))
        if name == "utf-8" and found[0][0] >= 0.55 + 0.40:  # no other strict decoding scores more, and UTF-8 wins ties
            break
    if guess := _guess(data):
        found.append((0.35 + 0.35 * guess[2] + 0.30 * printable_ratio(guess[1]), guess[0] == "utf-8", guess[0], guess[1], "charset-normalizer"))
    if not found:
        return "utf-8-replacement", 0.20, data.decode("utf-8", "replace"), "replacement"
    score, _, name, text, source = max(found, key=lambda f: f[:2])
    return name, max(0.0, min(1.0, score)), text, source


def _guess(data: bytes) -> tuple[str, str, float] | None:
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return None
    best = from_bytes(data).best()
    return (best.encoding, str(best), float(best.percent_coherence or 0.0) / 100) if best is not None and best.encoding else None


def normalized(text: str) -> str:
    """NFKC, without zero-width characters, escapes resolved. Escapes of lone surrogates stay as they are."""

    def put(m: re.Match[str]) -> str:
        if m[3]:
            return {"n": "\n", "r": "\r", "t": "\t"}[m[3]]
        c = int(m[1] or m[2], 16)
        return m[0] if 0xD800 <= c <= 0xDFFF else chr(c)

    return _ESCAPE.sub(put, unicodedata.normalize("NFKC", text).translate(INVISIBLE))


def _normalize(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else normalized(t))


def _infer(s: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None, None) if d is None else infer(bytes(d)) for d in s]
    return pd.DataFrame(rows, columns=["encoding", "confidence", "text", "source"])


def normalize_text(text) -> Column:
    return F.pandas_udf(_normalize, "string")(text)


def infer_encoding(data) -> Column:
    """struct(encoding, confidence, text, source)"""
    return F.pandas_udf(_infer, "encoding string, confidence double, text string, source string")(data)


def plain(text):
    """Texts that normalisation leaves alone, as a column: ASCII without a backslash."""
    return (F.octet_length(text) == F.length(text)) & ~text.contains("\\")
