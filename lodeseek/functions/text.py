"""Column functions over strings. All of them are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
STRONG_CARRIERS = ("structured", "json", "yaml", "xml", "csv", "sqlite", "xlsx")
TEXT_CARRIERS = ("text", "docx", "pptx", "pdf", "gettext")
DERIVED_CARRIERS = ("related-group", "recovery-plan", "image", "pdf-page")
FILLERS = "^(?:abcd|1234|deadbeef)+$"
# --- end of fixed values ---

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
UNPRINTABLE = r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ \r\n\t]]"


def entropy(v: Column) -> Column:
    """Shannon entropy in bits a character; 0 for the empty string."""
    n = F.length(v).cast("double")

    def bits(chars: Column) -> Column:
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n
        return F.aggregate(F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))

    # the split is bound to a variable, so that it is made once
    return F.when(F.length(v) == 0, 0.0).otherwise(F.get(F.transform(F.array(F.split(v, "")), bits), F.lit(0)))


def mask(v: Column) -> Column:
    """Redacted form: first line of a key block, else at most four characters at either end."""
    n = F.length(v)
    return (
        F.when(v.startswith("-----BEGIN"), F.concat(F.split_part(v, F.lit("\n"), F.lit(1)), F.lit("... [REDACTED]")))
        .when(n <= 8, F.repeat(F.lit("*"), n))
        .otherwise(F.concat(F.substring(v, 1, 4), F.repeat(F.lit("*"), F.least(F.lit(12), n - 8)), F.right(v, F.lit(4))))
    )


def fingerprint(v: Column) -> Column:
    return F.sha2(v, 256)


def crc_base62(payload: Column) -> Column:
    """Six base-62 digits of the CRC-32 of the payload's UTF-8 bytes."""
    crc = F.crc32(payload.cast("binary"))
    return F.concat(*[F.substring(F.lit(BASE62), (F.floor(crc / F.lit(62**k)) % 62 + 1).cast("int"), F.lit(1)) for k in range(5, -1, -1)])


def checksum_ok(v: Column) -> Column:
    n = F.length(v)
    return (n >= 7) & (F.right(v, F.lit(6)) == crc_base62(F.substring(v, F.lit(1), n - 6)))


def placeholder_key(v: Column) -> Column:
    """The form in which placeholders are compared (ASCII values; others are only lower-cased)."""
    return F.lower(F.btrim(v, F.lit(" \t\r\n\"'`.,;:")))


def repeated_filler(v: Column) -> Column:
    compact = F.lower(F.regexp_replace(v, "[^A-Za-z0-9]", ""))
    return (F.length(compact) >= 8) & ((F.size(F.array_distinct(F.split(compact, ""))) <= 2) | compact.rlike(FILLERS))


def carrier_score(kind: Column) -> Column:
    return F.when(kind.isin(*STRONG_CARRIERS), 1.0).when(kind.isin(*TEXT_CARRIERS), 0.6).when(kind.isin(*DERIVED_CARRIERS), 0.2).otherwise(0.0)


def natural_key(v: Column, width: int = 20) -> Column:
    """A string whose order is that of ``v`` with digit runs as numbers, other characters lower-cased."""
    parts = F.regexp_extract_all(v, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    key = lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(F.lower(p))
    # a text part comes before every number, as the empty one does
    first = F.when(v.rlike("^[0-9]"), "\u0001").otherwise("")
    return F.concat(first, F.array_join(F.transform(parts, key), "\u0001"))


def fragment_atom(v: Column) -> Column:
    """The usable part of a fragment, or null."""
    a = F.btrim(F.btrim(v, F.lit(" \t\r\n\x0b\x0c")), F.lit("\"'` ,;:"))
    letters = F.length(F.regexp_replace(a, "[^A-Za-z0-9]", ""))
    return F.when(F.length(a).between(2, 256) & ~a.rlike(r"(?U)\s") & (letters / F.length(a) >= 0.65), a)


def printable_ratio(v: Column) -> Column:
    return F.when(F.length(v) == 0, 1.0).otherwise(1 - F.regexp_count(v, F.lit(UNPRINTABLE)) / F.length(v))


def safe_member(name: Column) -> Column:
    """Archive member names that stay below their archive."""
    n = F.replace(name, F.lit("\\"), F.lit("/"))
    return ~n.startswith("/") & ~F.array_contains(F.split(n, "/"), "..")


def lines(v: Column) -> Column:
    """array<struct<n, line>> of lines that aren't blank, numbered from 1."""
    parts = F.transform(F.split(v, LINE_END), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    return F.filter(parts, lambda p: p["line"].rlike(r"(?U)\S"))
