"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Texts are sets of distinct shingles of ``size`` words; two texts link when
``100 * |x & y| >= percent * |x | y|``. All shingles are ordered alike in all
texts, rare ones first. A text of n shingles needs ``ceil(t * n)`` of them in
common with any partner, so linked texts share at least l of their first
``n - ceil(t * n) + l`` shingles, for every l. Each text picks its l from the
lengths of its shingles' posting lists: reading one more list costs its
length, but a candidate then needs one more shared shingle before its texts
are fetched and compared (Wang, Li and Feng, SIGMOD 2012).

Groups of near copies would make quadratic numbers of pairs. They are first
contracted: every posting list is compared with one pivot text a round, which
is linear, and texts linked to it or to its pivots form a part of a component.
Lists that lie in one part are finished. What remains is compared in full, but
only across parts and against each list's largest part, so every link that
joins two parts is found.

Edge cases. Null and empty texts have no shingles and link with nothing. Rows
with equal shingle sets are one class and are never paired. Rows that repeat an
id are each judged by their own text, and rows with a null id by theirs: a
component is named by its smallest id, and by null if it has none. Further
columns are ignored by ``jaccard_components`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from . import rows as R
from .components import components, hops
from .store import Workspace

#: Shingles that one sorted run of the frequency pass holds, and the count within a run from which one is reported.
RUN, RUN_COUNT = 1 << 21, 8
#: Most frequent shingles that are ordered by count; all others count as rare and are ordered by hash.
FREQUENT = 1 << 17
#: Largest number of shared prefix shingles that is asked for.
MOST = 6
#: Cost of fetching and comparing a candidate, in postings read.
VERIFY_COST = 8
PIVOT_ROUNDS = 3
#: Pairs whose sets a task holds at once.
PAIRS = 32
#: Words of a text's parity bitmap, and of the larger one that texts of more than LONG shingles also have.
WORDS64, LONG, MORE64 = 8, 512, 32


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """First row, end row and the shingle sets of runs of texts."""
    for i, j, buf, offs in K.blocks(texts):
        low = K.LOWER[buf]
        s, e, first = K.word_spans(low, offs)
        yield i, j, K.shingles(K.span_hashes(low, s, e), first, size)


def _runs(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= RUN_COUNT
            return pa.RecordBatch.from_arrays([pa.array(K.signed(h[keep])), pa.array(c[keep])], ["h", "c"])

        for b in batches:
            for _, _, sets in _sets(b.column(0), shingle):
                held += sets
                size += sum(map(len, sets))
                if size >= RUN:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


class Order:
    """The one order of all shingles: by how often the frequent ones occur, the rest by hash."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        by = np.argsort(h)
        self.h, self.c = h[by], c[by]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.h & K.U64((1 << 20) - 1)).astype(np.int64)] = True

    def counts(self, x: np.ndarray) -> np.ndarray | None:
        hit = np.flatnonzero(self.maybe[(x & K.U64((1 << 20) - 1)).astype(np.int64)])
        if not len(hit):
            return None
        at = np.minimum(np.searchsorted(self.h, x[hit]), len(self.h) - 1)
        same = self.h[at] == x[hit]
        if not same.any():
            return None
        out = np.zeros(len(x), np.int64)
        out[hit[same]] = self.c[at[same]]
        return out


def _signer(order: Order | None, percent: int, shingle: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sets in _sets(b.column("text"), shingle):
                s1, s2, prefix, bits, more = [], [], [], np.zeros((j - i, WORDS64), K.U64), []
                for r, x in enumerate(sets):
                    s1.append(int(x.sum()))
                    s2.append(int(K.mix(x ^ K.U64(0x5851F42D4C957F2D)).sum()))
                    if len(x):
                        bits[r] = _parities(x, WORDS64)
                    more.append(_parities(x, MORE64) if len(x) > LONG else x[:0])
                    k = min(len(x), len(x) - (percent * len(x) + 99) // 100 + MOST)
                    c = order.counts(x) if order and len(x) else None
                    prefix.append(x[:k] if c is None else x[np.argsort(c, kind="stable")[:k]])
                cols = [
                    *(b.column(c).slice(i, j - i) for c in ("doc_id", *R.KEY)),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(K.signed(np.array(s1, K.U64))),
                    pa.array(K.signed(np.array(s2, K.U64))),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * WORDS64 + 1, WORDS64, dtype=np.int32)), pa.array(K.signed(bits.ravel()))),
                    _lists(more),
                    _lists(prefix),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *R.KEY, "n_shingles", "s1", "s2", "bits", "more", "prefix"])

    return sign


def _parities(x: np.ndarray, words: int) -> np.ndarray:
    """For each of 64 * words classes of hashes one bit: whether an odd number of ``x`` is of the class."""
    odd = np.bincount((x >> K.U64(32)).astype(np.int64) & (words * 64 - 1), minlength=words * 64).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(K.U64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = K.signed(np.concatenate(values)) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]).astype(np.int32)), pa.array(flat))


def _linked(percent: int, shingle: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for at in range(0, b.num_rows, PAIRS):  # the sets of few pairs at a time
                xs, ys = ([x for _, _, sets in _sets(b.column(c).slice(at, PAIRS), shingle) for x in sets] for c in ("ta", "tb"))
                for x, y in zip(xs, ys, strict=True):
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return check


def _alike(percent: int, wide: bool):
    """Whether bitmaps allow a link: |x ^ y| <= (100 - percent) / (100 + percent) * (|x| + |y|) for linked sets, and bitmaps differ in no more bits."""
    bound = (F.col("na") + F.col("nb")) * (100 - percent)
    if not wide:
        apart = sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(WORDS64)), F.lit(0))
        return apart * (100 + percent) <= bound
    apart = F.aggregate(F.zip_with("more_a", "more_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return (F.size("more_a") == 0) | (F.size("more_b") == 0) | (apart * (100 + percent) <= bound)


def _candidates(left: DataFrame, right: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of postings (token, rep, n, level, l) that share l shingles of their l-prefixes and whose sizes and parity bitmaps allow a link.

    Postings that carry ``bits`` are compared within the join, so that most pairs that can't link are never made. The larger bitmaps
    are fetched for pairs only: carried by postings they would be shuffled once for every shingle of a long prefix.
    """
    early = "bits" in left.columns
    x = left.select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("level").alias("va"), F.col("l").alias("la"), *[c for c in left.columns if c in ("comp", "major")], *([F.col("bits").alias("bits_a")] if early else []))
    y = right.select(F.col("token").alias("token_b"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("level").alias("vb"), F.col("l").alias("lb"), *[F.col(c).alias(f"{c}_b") for c in right.columns if c in ("comp", "bits")])
    on = (
        (F.col("token") == F.col("token_b")) & (F.col("a") != F.col("b"))
        & (F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
        & (F.greatest("va", "vb") <= F.least("la", "lb"))
    )
    if "comp" in left.columns:
        on &= (F.col("comp") != F.col("comp_b")) & ((F.col("comp_b") == F.col("major")) | (F.col("a") < F.col("b")))
    if early:
        on &= _alike(percent, False)
    # a pair may be met as (a, b) in one list and as (b, a) in another; all its shared shingles are counted together
    p = x.join(y, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("la", "lb").alias("need"))
    p = p.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("need").alias("need")).where("shared >= need").select("a", "b")
    s = sig.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"), F.col("more").alias("more_a"))
    t = sig.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"), F.col("more").alias("more_b"))
    return p.join(s, "a").join(t, "b").where(_alike(percent, False) & _alike(percent, True)).select("a", "b")


def classes(docs: DataFrame, ws: Workspace, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row_id, text_hash, n_shingles, s1, s2) of ``docs``, and components (s1, s2, n_shingles, component) of its different shingle sets."""
    spark: SparkSession = docs.sparkSession
    docs = R.keyed(docs)
    common = docs.select("text").mapInArrow(_runs(size), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(FREQUENT).toPandas()
    order = Order(common.h.to_numpy().view(K.U64), common.c.to_numpy()) if len(common) else None
    held = spark.sparkContext.broadcast(order)
    sign = docs.mapInArrow(lambda it: _signer(held.value, percent, size)(it), "doc_id long, row_id long, text_hash long, n_shingles long, s1 long, s2 long, bits array<long>, more array<long>, prefix array<long>")
    signed = ws.table(sign, "signed")
    same = ["n_shingles", "s1", "s2"]
    one = signed.where("n_shingles > 0").groupBy(*same).agg(F.min_by(F.struct(*R.KEY, "bits", "more", "prefix"), F.struct(*R.KEY)).alias("x"))
    # classes are numbered as they are written, so a number stands for one shingle set whatever the ids are
    reps = ws.table(one.select(*same, F.monotonically_increasing_id().alias("rep"), *[F.col(f"x.{c}") for c in (*R.KEY, "bits", "more", "prefix")]), "classes")
    keys = ws.table(signed.select("doc_id", *R.KEY, *same), "rows")
    ws.drop(signed)
    sig = reps.select("rep", F.col("n_shingles").alias("n"), "bits", "more")
    places = reps.select("rep", *R.KEY)

    n, pos = F.col("n"), F.col("pos")
    need = F.expr(f"({percent} * n + 99) div 100")
    # ``ord`` follows the ids as far as a float tells them apart: texts of small ids, which copies tend to be made of, are the first pivots
    posts = reps.select("rep", F.col("row_id").cast("float").alias("ord"), F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    # the prefix for l shared shingles is the first n - need + l, so place pos (from 0) belongs to all l above pos - (n - need)
    posts = posts.select("token", "rep", "ord", n.cast("int").alias("n"), F.greatest(F.lit(1), pos - (n - need) + 1).cast("int").alias("level"), F.least(F.lit(MOST), need).cast("int").alias("most"))
    lists = posts.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
    live = ws.table(posts.join(lists, "token"), "postings")

    # l of each text: the least of lists read + comparisons, of which there are at most (lists read) / l
    read = [F.sum(F.when(F.col("level") <= k, F.col("length"))) for k in range(1, MOST + 1)]
    costs = [F.struct((r * (1.0 + VERIFY_COST / k)).alias("cost"), F.lit(k).alias("l")) for k, r in enumerate(read, 1)]
    chosen = live.groupBy("rep", "most").agg(F.array(*costs).alias("costs")).select("rep", F.array_min(F.filter("costs", lambda c: c.cost.isNotNull() & (c.l <= F.col("most"))))["l"].alias("l"))
    # a text whose short prefix meets nothing shares nothing at that length, and needs no longer one
    posts = ws.table(live.join(chosen, "rep").where("level <= l").select("token", "rep", "ord", "n", "level", "l"), "chosen")
    ws.drop(live)
    edges, comp = None, None

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = ws.table(pairs, f"{name}-pairs")
        nodes = ws.table(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(places, "rep"), f"{name}-nodes")
        t = ws.table(R.within(docs, nodes).select("rep", F.col("d.text").alias("text")), f"{name}-texts")
        full = pairs.join(t.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(t.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
        out = ws.table(full.select("a", "b", "ta", "tb").mapInArrow(_linked(percent, size), "a long, b long"), f"{name}-links")
        ws.drop(t, nodes, pairs)
        return out

    for r in range(PIVOT_ROUNDS):
        if comp is None:
            members = posts
            pivot = posts.groupBy("token").agg(F.min_by(F.struct("rep", "n", "level", "l"), F.struct("ord", "rep")).alias("p")).select("token", "p.*")
        else:
            members = posts.join(comp.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label")
            spread = members.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
            opened = members = ws.table(members.join(spread, "token"), "open")
            by = F.xxhash64("rep", F.lit(r))
            pivot = members.groupBy("token").agg(F.min_by(F.struct("rep", "n", "level", "l", "comp"), F.struct(by, "rep")).alias("p")).select("token", "p.*")
            members = members.withColumn("major", F.lit(None).cast("long"))
            members = members.join(pivot.select("token", F.col("comp").alias("of_pivot")), "token").withColumn("major", F.col("of_pivot")).drop("of_pivot")
        found = verified(_candidates(members, pivot, sig, percent), f"pivot{r}")
        if comp is not None:
            ws.drop(opened, comp)
        edges = found if edges is None else edges.unionByName(found)
        # what is known to be linked need not be whole components yet: these are made of all links at the end
        comp = ws.table(hops(edges), "labels")
    members = posts.join(comp.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label")
    spread = members.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"), F.count("*").alias("comps")).where("comps > 1")
    members = ws.table(members.join(spread.select("token", "major"), "token").join(sig.select("rep", "bits"), "rep"), "open")
    ws.drop(posts, comp)
    rest = _candidates(members.where("comp <> major"), members.drop("major"), sig, percent)
    edges = edges.unionByName(verified(rest, "rest"))
    ws.drop(members)
    comp = ws.table(components(edges, ws), "labels")
    label = reps.select(*same, "rep").join(comp.select(F.col("node").alias("rep"), "label"), "rep", "left")
    return keys, ws.table(label.select(*same, F.coalesce("label", "rep").alias("component")), "components")


def jaccard_components(docs: DataFrame, ws: Workspace | None = None, percent: int = 90, size: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    ws = ws or Workspace(docs.sparkSession, "jaccard")
    rows, label = classes(docs, ws, percent, size)
    same = ["n_shingles", "s1", "s2"]
    # the smallest id of each shingle set, then of each component: both are minima that combine before the shuffle
    first = rows.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("first")).join(label, same)
    named = first.groupBy("component").agg(F.min("first").alias("component_id"))
    label = ws.table(label.join(named, "component").select(*same, "component_id"), "names")
    out = rows.join(label, same, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, ws: Workspace | None = None, percent: int = 80, size: int = 5) -> DataFrame:
    """``docs`` (doc_id, text, further columns) with one row of each component: that with the smallest id, or of rows without ids any one.

    Rows without shingles all stay. Of rows that repeat an id and a text one stays; other rows that repeat an id are judged by their own texts.
    """
    ws = ws or Workspace(docs.sparkSession, "deduplicated")
    rows, label = classes(docs, ws, percent, size)
    r = rows.where("n_shingles > 0").join(label, ["n_shingles", "s1", "s2"])
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), *R.KEY)
    best = r.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("k")).where("k > 1").select("component", "best")
    r = ws.table(r.join(best, "component").select(*R.KEY, (order == F.col("best")).alias("stays")), "groups")
    gone = r.where("not stays").select(*R.KEY)
    again = ws.table(r.where("stays").groupBy(*R.KEY).agg(F.count("*").alias("k")).where("k > 1").select(*R.KEY), "repeated")
    if again.isEmpty():
        return R.without(docs, gone, ws)
    once = R.within(docs, again).select("d.*")
    return R.without(docs, gone.unionByName(again), ws).unionByName(once)
