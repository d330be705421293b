"""Mixing sources to target weights from packed blocks.

Every source's words are packed, document after document, into blocks of
``block`` words. The mix is a sequence of slots, dealt over output shards. Each
shard draws its own multinomial counts of the sources; the n-th draw from a
source takes the block at place n of the source's pseudorandom permutation, and
a new permutation begins when all its blocks are used, so no block is taken
twice before every block was taken once. The few draws by which the sum of a
source's counts exceeds its exact number go to the sources that fell short, so
totals meet the targets to within one block, and none exceeds ``epochs`` passes.

Positions come from two-level running sums (bucket totals, then rows of a
bucket), with about as many buckets as rows in one, so that a source with a
third of all rows is spread over many tasks; so do the places of a shard's draws
among its source's. Slots are expanded by shard, never by source. All random
numbers are functions of a seed and an index: reruns and retried tasks agree.

Edge cases. Null texts have no words: such documents take part with size 0. A
null source is a source of its own, sorted last. Repeated rows are documents of
their own. An empty table gives no rows. Further columns are ignored. The
number of sources is limited to ``MAX_SOURCES``; more raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernel import U64, mix
from .store import Workspace

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK, SHARD_SLOTS, EPOCHS, SEED = 32, 4096, 3, 20240607
#: Output shards that one task draws or expands, at most 20,000 tasks.
SHARDS_PER_TASK, TASKS = 32, 20_000
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> list[float]:
    """Shares of sum(sizes) by repeating weights, none above ``epochs`` times its size; what is above is shared again."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    while open_:
        total = sum(w[k] for k in open_)
        over = [k for k in open_ if left * w[k] / total > epochs * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * w[k] / total
            break
        for k in over:
            out[k] = float(epochs * sizes[k])
            left -= out[k]
        gone = set(over)
        open_ = [k for k in open_ if k not in gone]
        left = max(left, 0.0)
    return out


def permuted(j: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The images of ``j`` (in 0..n-1) under a pseudorandom permutation of 0..n-1: a Feistel network with cycle walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = U64((1 << half) - 1)
    keys = mix(np.arange(1, 5, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed & (2**64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> U64(half), x & low
        for k in keys:
            a, b = b, a ^ (mix(b + k) & low)
        return (a << U64(half)) | b

    x = once(j.astype(U64))
    while (out := np.flatnonzero(x >= U64(n))).size:
        x[out] = once(x[out])
    return x.astype(np.int64)


@dataclass(frozen=True)
class Source:
    sid: int
    name: str | None
    size: int
    docs: int
    target: float
    blocks: int
    draws: int


def plan_sources(rows: list[tuple[str | None, int, int]], block: int = BLOCK, epochs: int = EPOCHS) -> list[Source]:
    """Sources by code point, null last, with targets and numbers of draws; rows: (source, size, documents)."""
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"{len(rows)} sources; at most {MAX_SOURCES} are supported")
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    out = []
    for k, ((name, size, docs), target) in enumerate(zip(rows, targets([r[1] for r in rows], epochs=epochs), strict=True)):
        blocks = -(-size // block)
        draws = min(epochs * blocks, round(target * blocks / size)) if size else 0
        out.append(Source(k, name, size, docs, target, blocks, draws))
    return out


def layout(docs: DataFrame, ws: Workspace, block: int = BLOCK) -> tuple[DataFrame, list[Source]]:
    """doc_id, sid, size, off (the document's first word in its source) and the sources."""
    spark = docs.sparkSession
    sized = ws.table(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    found = sized.groupBy("source").agg(F.sum("size"), F.count("*")).limit(MAX_SOURCES + 1).collect()
    sources = plan_sources([tuple(r) for r in found], block)
    names = spark.createDataFrame([(s.name, s.sid, max(1, math.isqrt(s.docs))) for s in sources], "name string, sid int, buckets int")
    d = sized.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name"))).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")).cast("int"))
    totals = d.groupBy("sid", "bucket").agg(F.sum("size").alias("s"))
    before = totals.select("sid", "bucket", (F.sum("s").over(W.partitionBy("sid").orderBy("bucket")) - F.col("s")).alias("before"))
    rows = W.partitionBy("sid", "bucket").orderBy("doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("within", F.sum("size").over(rows) - F.col("size")).join(before, ["sid", "bucket"])
    return ws.table(d.select("doc_id", "sid", "size", (F.col("before") + F.col("within")).alias("off")), "layout"), sources


def shard_counts(docs: DataFrame, sources: list[Source], slots_per_shard: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """shard, sid, n: the multinomial counts of every output shard."""
    draws = np.array([s.draws for s in sources], np.int64)
    n, p = int(draws.sum()), draws / max(1, draws.sum())

    def draw(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for shard in pdf["id"]:
                size = min(slots_per_shard, n - int(shard) * slots_per_shard)
                c = np.random.default_rng([seed, int(shard)]).multinomial(size, p)
                yield pd.DataFrame({"shard": shard, "sid": np.flatnonzero(c).astype(np.int32), "n": c[c > 0]})

    shards = -(-n // slots_per_shard)
    return docs.sparkSession.range(0, shards, numPartitions=_tasks(shards)).mapInPandas(draw, "shard long, sid int, n long")


def _tasks(shards: int) -> int:
    return max(1, min(TASKS, -(-shards // SHARDS_PER_TASK)))


def slots(docs: DataFrame, sources: list[Source], ws: Workspace, slots_per_shard: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """shard, sid, block: one row for every slot of the mix."""
    counts = ws.table(shard_counts(docs, sources, slots_per_shard, seed), "counts")
    draws, blocks = np.array([s.draws for s in sources], np.int64), np.array([s.blocks for s in sources], np.int64)
    drawn = np.zeros(len(sources), np.int64)
    for sid, k in counts.groupBy("sid").agg(F.sum("n")).collect():
        drawn[sid] = k
    over, under = np.maximum(drawn - draws, 0), np.maximum(draws - drawn, 0)
    over_from, under_to = np.cumsum(over) - over, np.cumsum(under)
    # running sums in two levels, so that no source is summed in one task
    shards = -(-int(draws.sum()) // slots_per_shard)
    each = max(1, math.isqrt(shards))
    grouped = counts.withColumn("group", F.expr(f"shard div {each}"))
    totals = grouped.groupBy("sid", "group").agg(F.sum("n").alias("s"))
    before = totals.select("sid", "group", (F.sum("s").over(W.partitionBy("sid").orderBy("group")) - F.col("s")).alias("before"))
    within = F.sum("n").over(W.partitionBy("sid", "group").orderBy("shard")) - F.col("n")
    first = grouped.withColumn("within", within).join(before, ["sid", "group"]).select("shard", "sid", "n", (F.col("before") + F.col("within")).alias("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for shard, sid, n, at in zip(*(b.column(c).to_numpy() for c in ("shard", "sid", "n", "first")), strict=True):
                held.append(_placed(int(shard), int(sid), int(n), int(at)))
                size += int(n)
                if size > 1 << 18:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    def out(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["shard", "sid", "block"])

    def _placed(shard: int, sid: int, n: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        j, s = np.arange(at, at + n, dtype=np.int64), np.full(n, sid, np.int64)
        if (late := np.flatnonzero(j >= draws[sid])).size:
            g = over_from[sid] + j[late] - draws[sid]
            to = np.searchsorted(under_to, g, side="right")
            s[late], j[late] = to, drawn[to] + g - (under_to[to] - under[to])
        b = np.empty(n, np.int64)
        for k in np.unique(s):
            epoch = j // blocks[k]
            for e in np.unique(epoch[s == k]):
                m = (s == k) & (epoch == e)
                b[m] = permuted(j[m] - e * blocks[k], int(blocks[k]), hash((seed, int(k), int(e))))
        return np.full(n, shard, np.int64), s.astype(np.int32), b

    return first.repartition(_tasks(shards), "shard").mapInArrow(place, "shard long, sid int, block long")


def _pieces(lay: DataFrame, block: int) -> DataFrame:
    """The blocks that each document has words in: sid, off, size, block, words."""
    d = lay.where("size > 0").select("sid", "off", "size", F.explode(F.expr(f"sequence(off div {block}, (off + size - 1) div {block})")).alias("block"))
    return d.withColumn("words", F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("off", F.col("block") * block))


def taken(docs: DataFrame, ws: Workspace | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, source, text)."""
    spark, ws = docs.sparkSession, ws or Workspace(docs.sparkSession, "mixture")
    lay, sources = layout(docs, ws, block)
    # blocks and documents grow with the corpus: merge joins at every size, never a broadcast
    times = slots(docs, sources, ws).groupBy("sid", "block").agg(F.count("*").alias("times"))
    got = _pieces(lay, block).join(times.hint("merge"), ["sid", "block"]).groupBy("sid", "off").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    info = spark.createDataFrame([(s.sid, s.name, s.size, s.target) for s in sources], "sid int, source string, source_size long, target double")
    out = lay.withColumn("key", F.when(F.col("size") > 0, F.col("off"))).join(got.select("sid", F.col("off").alias("key"), "taken").hint("merge"), ["sid", "key"], "left")
    return out.join(F.broadcast(info), "sid").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, ws: Workspace | None = None, block: int = BLOCK) -> DataFrame:
    """shard, source, block, text: the mix itself, one row for every slot, its words joined by spaces."""
    spark, ws = docs.sparkSession, ws or Workspace(docs.sparkSession, "mixture")
    lay, sources = layout(docs, ws, block)
    words = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD), F.lit(0)).alias("w"))
    info = spark.createDataFrame([(s.sid, s.name) for s in sources], "sid int, source string")
    rank = F.row_number().over(W.partitionBy("doc_id", "sid", "size").orderBy("off"))
    where = lay.withColumn("k", rank)
    words = words.join(F.broadcast(info.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name"))).withColumn("size", F.size("w").cast("long"))
    words = words.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "sid", "size").orderBy("w"))).where("size > 0")
    d = words.join(where, ["sid", "size", "k"]).where(words.doc_id.eqNullSafe(where.doc_id)).select("sid", "off", "w", F.explode(F.expr(f"sequence(off div {block}, (off + size - 1) div {block})")).alias("block"))
    low = F.greatest("off", F.col("block") * block) - F.col("off")
    part = F.slice("w", (low + 1).cast("int"), (F.least(F.col("off") + F.size("w"), (F.col("block") + 1) * block) - F.col("off") - low).cast("int"))
    packed = d.select("sid", "block", F.struct("off", part.alias("w")).alias("p")).groupBy("sid", "block").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    packed = packed.select("sid", "block", F.array_join(F.flatten(F.transform("ps", lambda p: p["w"])), " ").alias("text"))
    return slots(docs, sources, ws).join(packed, ["sid", "block"]).join(F.broadcast(info), "sid").select("shard", "source", "block", "text")
