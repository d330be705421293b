"""Encoded tokens and their strict decodings, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import printable_ratio

# --- fixed values: what counts as an encoded token ---
BASE64 = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])"
HEX = r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,}(?![0-9A-Fa-f])"
URL = r"(?U)\S*%[0-9A-Fa-f]{2}\S*"
# --- end of fixed values ---


def tokens(text: Column) -> Column:
    """array<struct<token, encoding>>: Base64 ones first, then hexadecimal ones of even length, then URL ones, each in order."""

    def named(pattern: str, encoding) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: F.struct(t.alias("token"), encoding(t).alias("encoding")))

    b64 = named(BASE64, lambda t: F.when(t.rlike("[-_]"), "base64url").otherwise("base64"))
    hexes = F.filter(named(HEX, lambda t: F.lit("hex")), lambda s: F.length(s["token"]) % 2 == 0)
    return F.concat(b64, hexes, named(URL, lambda t: F.lit("url")))


def _from_base64(t: Column) -> Column:
    padded = F.concat(t, F.repeat(F.lit("="), F.pmod(-F.length(t), F.lit(4)).cast("int")))
    plain = padded.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(plain, F.try_to_binary(padded, F.lit("base64")))


def _as_text(raw: Column) -> Column:
    s = raw.cast("string")
    return F.when(F.is_valid_utf8(s), s)


def decoded(token: Column, encoding: Column, max_output: int = 1 << 20) -> Column:
    """The decoded text, or null unless it is valid UTF-8, at least nine tenths printable, without NUL and within the limit.

    URL tokens keep ``+`` and malformed ``%``; a decoding that holds U+FFFD counts as invalid.
    """
    # a URL-safe token that also holds + or / isn't of one alphabet
    url64 = F.when(~token.rlike("[+/]"), _from_base64(F.translate(token, "-_", "+/")))
    percent = F.try_url_decode(F.replace(F.regexp_replace(token, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))
    out = (
        F.when(encoding == "base64", _as_text(_from_base64(token)))
        .when(encoding == "base64url", _as_text(url64))
        .when(encoding == "hex", _as_text(F.try_to_binary(token, F.lit("hex"))))
        .when(encoding == "url", F.when(~percent.contains("�"), percent))
    )
    good = lambda o: (F.length(o) > 0) & ~o.contains("\u0000") & (F.octet_length(o) <= max_output) & (printable_ratio(o) >= 0.9)
    # bound to a variable, so that it is decoded once
    return F.get(F.filter(F.array(out), good), F.lit(0))
