"""Strict decodings for single values outside a DataFrame."""

from __future__ import annotations

import base64
from urllib.parse import unquote

from .encoding import printable_ratio


def strict(value: str, encoding: str, limit: int) -> str:
    """The decoded text; raises ValueError where it isn't readable text within the limit."""
    if encoding == "hex":
        raw = bytes.fromhex(value)
    elif encoding == "url":
        raw = unquote(value, errors="strict").encode()
    elif encoding in ("base64", "base64url"):
        raw = base64.b64decode(value + "=" * (-len(value) % 4), altchars=b"-_" if encoding == "base64url" else None, validate=True)
    else:
        raise ValueError(f"unknown encoding {encoding}")
    text = raw.decode("utf-8")
    if not text or "\0" in text or len(raw) > limit or printable_ratio(text) < 0.9:
        raise ValueError("decoded value is not readable text within the limit")
    return text
