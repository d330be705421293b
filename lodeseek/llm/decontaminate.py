"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

Test items are cut into windows of ``size`` consecutive words. Of every window
only its rarest terms are looked up: term counts come from the whole corpus.
The index holds the positions of these terms in every document. Each posting is
shifted by its term's offset in the item, which gives the alignment at which
the item would stand in the document; where the lists of a window's rarest
terms meet at one alignment, the window is a candidate. Alignments of one item
share a group, so overlapping windows are intersected together and a posting is
shuffled once for each place of its term among the item's anchors. Only then
candidates are compared with the document's own words, so results are exact
phrases. Proximity search reads the same index.

The plan is the same at every size. While the test set has at most ``SMALL``
words its tables are broadcast; beyond that the same joins shuffle them.

Edge cases. Null texts have no words. An item shorter than a window is one
window; an item without words matches nothing. Items with a null id are matched
but not named. Rows are judged each by its own text, whatever their ids (null
and repeated ids included). Further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rows as R
from .store import Workspace

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the test set up to which its tables are broadcast; each is some ten bytes in each of them.
SMALL = 500_000
#: Rarest terms of a window whose lists are intersected before whole phrases are compared.
RAREST = 2
#: Rarest terms of an item that proximity search looks for, and the words between which they stand.
NEAR_TERMS, NEAR_SPAN = 3, 20


def words(text: Column) -> Column:
    """Words after lower-casing A-Z; ASCII texts take the fast path."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, SEPARATORS), "")


class Items:
    """The test items with words, numbered as they are written, and how their tables are joined."""

    def __init__(self, items: DataFrame, ws: Workspace):
        w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
        self.table = ws.table(w.select(F.monotonically_increasing_id().alias("item"), "item_id", "w"), "items")
        self.small = (self.table.agg(F.sum(F.size("w"))).first()[0] or 0) <= SMALL

    def side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def counted(items: Items, docs: DataFrame, ws: Workspace) -> DataFrame:
    """item, offset, term, df: the words of all items with their counts in ``docs``, 0 if there is none."""
    each = items.table.select("item", F.posexplode("w").alias("offset", "term"))
    terms = ws.table(each.select("term").distinct(), "terms")
    seen = docs.select(F.explode(words(F.col("text"))).alias("term")).join(items.side(terms), "term")
    counts = ws.table(seen.groupBy("term").agg(F.count("*").alias("df")), "counts")
    return ws.table(each.join(items.side(counts), "term", "left").select("item", "offset", "term", F.coalesce("df", F.lit(0)).alias("df")), "counted")


def window_plan(items: Items, terms: DataFrame, size: int, rarest: int = RAREST) -> DataFrame:
    """item, start, len, offsets: the windows that can occur, and the offsets in the item of the ``rarest`` different terms of each."""
    starts = items.table.select("item", F.size("w").alias("n")).select("item", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0)))).alias("start"))
    starts = starts.select("item", "start", F.least("n", F.lit(size)).alias("len"))
    # each word belongs to the at most ``size`` windows that begin up to size - 1 words before it
    at = terms.select("item", "offset", "term", "df", F.explode(F.sequence(F.greatest(F.col("offset") - size + 1, F.lit(0)), F.col("offset"))).alias("start"))
    t = at.join(starts, ["item", "start"]).groupBy("item", "start", "len", "term").agg(F.min("offset").alias("offset"), F.first("df").alias("df"))
    t = t.groupBy("item", "start", "len").agg(F.slice(F.sort_array(F.collect_list(F.struct("df", "term", "offset"))), 1, rarest).alias("rare"))
    # a window with a term that no document has cannot occur
    return t.where(F.col("rare")[0]["df"] > 0).select("item", "start", "len", F.transform("rare", lambda r: r["offset"]).alias("offsets"))


def near_plan(terms: DataFrame, rarest: int = NEAR_TERMS) -> DataFrame:
    """item, rank, term, lists: the ``rarest`` different terms of each item whose terms all occur, the rarest one first."""
    t = terms.groupBy("item", "term").agg(F.first("df").alias("df")).groupBy("item").agg(F.slice(F.sort_array(F.collect_list(F.struct("df", "term"))), 1, rarest).alias("rare"))
    t = t.where(F.col("rare")[0]["df"] > 0)
    return t.select("item", F.size("rare").alias("lists"), F.posexplode("rare").alias("rank", "r")).select("item", "rank", "r.term", "lists")


def postings(docs: DataFrame, terms: DataFrame, items: Items) -> DataFrame:
    """term, row_id, text_hash, pos: the positional index of ``docs`` for the rows of ``terms`` (term)."""
    p = docs.select(*R.KEY, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return p.join(items.side(terms), "term").select("term", *R.KEY, "pos")


def _bit(offset: Column) -> Column:
    """One of 64 bits for an offset: what meets is exact for items of up to 64 words and a superset beyond, which the comparison settles."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(offset, F.lit(64)).cast("int"))


def aligned(index: DataFrame, plan: DataFrame, terms: DataFrame, items: Items, ws: Workspace) -> DataFrame:
    """row_id, text_hash, item, shift, start, len: windows whose lists meet at the word ``shift + start`` of a document."""
    mask = F.aggregate("offsets", F.lit(0).cast("long"), lambda m, o: m.bitwiseOR(_bit(o)))
    plan = plan.withColumn("mask", mask)
    places = plan.select("item", F.bit_count("mask").alias("bits"), F.explode("offsets").alias("offset")).groupBy("item", "offset").agg(F.min("bits").alias("least"))
    places = ws.table(places.join(terms.select("item", "offset", "term"), ["item", "offset"]), "anchors")
    shifted = index.join(items.side(places), "term").select(*R.KEY, "item", (F.col("pos") - F.col("offset")).alias("shift"), _bit(F.col("offset")).alias("bit"), "least")
    met = shifted.groupBy(*R.KEY, "item", "shift").agg(F.bit_or("bit").alias("met"), F.min("least").alias("least")).where(F.bit_count("met") >= F.col("least"))
    windows = plan.groupBy("item").agg(F.collect_list(F.struct("start", "len", "mask")).alias("windows"))
    full = F.filter("windows", lambda w: (w["mask"].bitwiseAND(F.col("met")) == w["mask"]) & (F.col("shift") + w["start"] >= 0))
    found = met.join(items.side(windows), "item").select(*R.KEY, "item", "shift", F.explode(full).alias("w"))
    return ws.table(found.select(*R.KEY, "item", "shift", "w.start", "w.len"), "candidates")


def compared(docs: DataFrame, candidates: DataFrame, items: Items, ws: Workspace) -> DataFrame:
    """row_id, text_hash, item_id, start, at, len: the candidates that are exact phrases of their documents."""
    texts = R.within(docs.select("doc_id", "text"), candidates.select(*R.KEY).distinct())
    texts = texts.select(*R.KEY, words(F.col("d.text")).alias("words"))
    both = candidates.hint("merge").join(texts.hint("merge"), R.KEY).join(items.side(items.table), "item")
    at = F.col("shift") + F.col("start")
    same = F.slice("words", at + 1, F.col("len")) == F.slice("w", F.col("start") + 1, F.col("len"))
    return both.where(same).select(*R.KEY, "item_id", "start", at.alias("at"), "len")


class Search:
    """One index of ``docs`` (doc_id, text) for phrases and proximity of ``items`` (item_id, text)."""

    def __init__(self, docs: DataFrame, items: DataFrame, ws: Workspace, size: int = 10, near: bool = True):
        self.docs, self.ws = R.keyed(docs), ws
        self.items = Items(items.select("item_id", "text"), ws)
        self.terms = counted(self.items, self.docs, ws)
        self.plan = ws.table(window_plan(self.items, self.terms, size), "plan")
        self.near = ws.table(near_plan(self.terms), "near-plan") if near else None
        wanted = self.plan.select("item", F.explode("offsets").alias("offset")).join(self.terms, ["item", "offset"]).select("term")
        if near:
            wanted = wanted.unionByName(self.near.select("term"))
        self.index = ws.table(postings(self.docs, wanted.distinct(), self.items), "index")

    def occurrences(self) -> DataFrame:
        """row_id, text_hash, item_id, start, at, len: each place where a window of an item occurs, from word ``at`` of the document."""
        found = aligned(self.index, self.plan, self.terms, self.items, self.ws)
        return self.ws.table(compared(self.docs, found, self.items, self.ws), "occurrences")

    def proximity(self, span: int = NEAR_SPAN) -> DataFrame:
        """row_id, text_hash, item_id, at: an item's rarest terms all stand within ``span`` words of word ``at``, the rarest one, in any order."""
        p = self.index.join(self.items.side(self.near), "term")
        # positions are dealt to buckets of ``span`` words and their neighbours, so a group holds at most 3 * span positions
        here = F.expr(f"pos div {span}")
        p = p.select(*R.KEY, "item", "lists", "rank", "pos", F.explode(F.when(F.col("rank") == 0, F.array(here)).otherwise(F.array(here - 1, here, here + 1))).alias("bucket"))
        g = p.groupBy(*R.KEY, "item", "bucket").agg(F.collect_set(F.struct("rank", "pos")).alias("ps"), F.first("lists").alias("lists"), F.max((F.col("rank") == 0).cast("int")).alias("has"))
        others = F.sequence(F.lit(1), F.greatest(F.col("lists") - 1, F.lit(1)))
        beside = lambda a: F.forall(others, lambda r: F.exists("ps", lambda x: (x["rank"] == r) & (F.abs(x["pos"] - a["pos"]) <= span)))
        hit = F.filter("ps", lambda a: (a["rank"] == 0) & ((F.col("lists") == 1) | beside(a)))
        found = g.where("has = 1").select(*R.KEY, "item", F.explode(hit).alias("a")).select(*R.KEY, "item", F.col("a.pos").alias("at"))
        return found.join(self.items.side(self.items.table.select("item", "item_id")), "item").select(*R.KEY, "item_id", "at").distinct()


def occurrences(docs: DataFrame, items: DataFrame, ws: Workspace, size: int = 10) -> DataFrame:
    """row_id, text_hash, item_id, start, at, len of every occurrence."""
    return Search(docs, items, ws, size, near=False).occurrences()


def contamination(docs: DataFrame, items: DataFrame, ws: Workspace | None = None, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near for every row of ``docs``; n_near counts items whose rarest terms stand close together."""
    ws = ws or Workspace(docs.sparkSession, "decontaminate")
    search = Search(docs, items, ws, size)
    occ = search.occurrences()
    hit = occ.select(*R.KEY, F.explode(F.sequence("at", F.col("at") + F.col("len") - 1)).alias("p")).distinct().groupBy(*R.KEY).agg(F.count("*").alias("n_hit"))
    named = occ.select(*R.KEY, F.col("item_id").alias("item")).distinct().groupBy(*R.KEY).agg(F.sort_array(F.collect_list("item")).alias("items"))
    near = search.proximity().select(*R.KEY, "item_id").distinct().groupBy(*R.KEY).agg(F.count("item_id").alias("n_near"))
    out = search.docs.select("doc_id", *R.KEY, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    for more in (hit, named, near):
        out = out.join(more.hint("merge"), R.KEY, "left")  # these grow with the corpus: never broadcast, at any size
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, ws: Workspace | None = None, size: int = 10) -> DataFrame:
    """``docs`` (doc_id, text, further columns) without the rows whose text holds a window of an item."""
    ws = ws or Workspace(docs.sparkSession, "decontaminated")
    return R.without(docs, occurrences(docs, items, ws, size), ws)
