"""Rows told apart without trusting their ids.

Ids may be null or repeated, so a row is known by ``row_id`` (its id, or the
hash of its text where the id is null) and ``text_hash``. Rows with equal keys
hold the same text under the same id.

``within`` and ``without`` pick rows by keys. A bitmap of fixed size (4 MB,
broadcast) tells first which rows can't be among the keys; only the others,
with their texts, are shuffled for the exact join. Beyond some ten million keys
the bitmap fills up and more rows take the exact join: slower, never wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

KEY = ["row_id", "text_hash"]
#: Bitmaps and bits in each; the bits are fixed by Spark's bitmap functions.
BITMAPS, BITS = 1024, 32768


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def row_id(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), text_hash(text))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, row_id, text_hash of ``docs`` (doc_id, text)."""
    d, t = F.col("doc_id"), F.col("text")
    return docs.select(d.cast("long").alias("doc_id"), t.cast("string").alias("text"), row_id(d, t).alias("row_id"), text_hash(t).alias("text_hash"))


def columns(docs: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``docs`` has, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n in taken:
            n = f"_{n}"
        taken.add(n)
        out.append(n)
    return out


def _place(a: Column, b: Column) -> tuple[Column, Column]:
    spot = F.xxhash64(a, b)
    return F.pmod(spot, F.lit(BITMAPS)).cast("int"), F.pmod(F.shiftright(spot, 20), F.lit(BITS))


def _marked(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, str, list[str]]:
    """``docs`` with its key columns and a column that is false where a row's key isn't among ``keys``."""
    a, b, at, bit, bits, maybe = _fresh(docs, "row_key", "hash_key", "at_key", "bit_key", "bits_key", "maybe_key")
    here, place = _place(F.col("row_id"), F.col("text_hash"))
    maps = keys.select(here.alias(at), place.alias(bit)).groupBy(at).agg(F.bitmap_construct_agg(bit).alias(bits))
    d = docs.withColumns({a: row_id(F.col("doc_id"), F.col("text")), b: text_hash(F.col("text"))})
    here, place = _place(F.col(a), F.col(b))
    d = d.withColumns({at: here, bit: place}).join(F.broadcast(maps), at, "left")
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast({bit} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    d = d.withColumn(maybe, F.coalesce(F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1, F.lit(False)))
    return d.drop(at, bit, bits), maybe, [a, b]


def _renamed(keys: DataFrame, names: list[str]) -> DataFrame:
    return keys.select(*[F.col(k).alias(n) for k, n in zip(KEY, names, strict=True)])


def without(docs: DataFrame, keys: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of ``docs`` (with doc_id, text) whose keys aren't among ``keys`` (row_id, text_hash)."""
    keys = ws.table(keys.select(*KEY).distinct(), "keys")
    d, maybe, names = _marked(docs, keys)
    rest = d.where(maybe).join(_renamed(keys, names).hint("merge"), names, "left_anti")
    return d.where(~F.col(maybe)).select(*columns(docs)).unionByName(rest.select(*columns(docs)))


def within(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with doc_id, text) whose keys are among ``keys`` (row_id, text_hash, and columns of its own), with these columns; equal rows are one.

    ``keys`` is read twice and holds no key twice.
    """
    d, maybe, names = _marked(docs, keys.select(*KEY))
    more = [c for c in keys.columns if c not in KEY]
    k = keys.select(*[F.col(c).alias(n) for c, n in zip(KEY, names, strict=True)], *[F.col(c).alias(f"k_{c}") for c in more])
    found = d.where(maybe).join(k.hint("merge"), names)
    one = found.groupBy(*names).agg(F.first(F.struct(*columns(docs))).alias("d"), *[F.first(f"k_{c}").alias(f"k_{c}") for c in more])
    return one.select(*[F.col(n).alias(c) for c, n in zip(KEY, names, strict=True)], F.col("d"), *[F.col(f"k_{c}").alias(c) for c in more])
