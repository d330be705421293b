"""Language-model scoring by context-tree weighting.

A text is its tokens: lower-cased (A-Z) words, each closed by a space, then one
end, coded as a newline. The context of a byte is the ``DEPTH`` bytes before it
in this stream, across words; before a text stand newlines. Every byte is
decomposed into eight binary decisions, each with a context tree of its own. A
node's Krichevsky-Trofimov estimate P_e and its children give P_w = P_e / 2 +
(product of the children's P_w) / 2, so every node stops with the posterior
weight P_e / (2 P_w); a bit's probability mixes the estimates of all depths by
these weights, down to the deepest context that training saw.

All follows from counts of (context, byte) grams, which grow with the input.
Tasks merge the grams of their texts before the shuffle; trees are weighted
from the leaves up, dealt by the three nearest context bytes, and the depths
above these are finished on the driver, where they have at most 256 * 256 * 255
nodes by construction. Every gram gets its code length, and texts are summed:
the most frequent grams (``HOT_GRAMS``) and words (``HOT_WORDS``, for the base
score) are broadcast, which is a fixed size, and all others are joined by key,
so no frequent key is ever shuffled and nothing is left out. Words are counted
and looked up by 64-bit hashes.

Edge cases. Null texts are empty: one end token. Null ids belong to the
training part. Without training texts every probability is that of an empty
model (1/2 a bit). Rows that repeat an id are scored one by one. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma, log, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .language import held_out
from .store import Workspace

DEPTH = 6
HOT_WORDS, HOT_GRAMS = 1 << 18, 1 << 21
#: Contexts of up to this depth are weighted on the driver, deeper ones where their grams are.
SHALLOW = 2
GRAMS_PER_TASK = 250_000
#: Bytes of text whose grams are sorted at once, and different grams that a task merges before it hands them on.
RUN_BYTES, MERGED = 1 << 20, 2_000_000
END = 0x0A
_HALF = log(0.5)
_LGAMMA = np.array([lgamma(x / 2) if x else 0.0 for x in range(2, 4096)])  # index x - 2


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for positive multiples of one half."""
    out = np.empty(len(x))
    small = x < 2000
    k = np.round(x[small] * 2).astype(np.int64)
    out[small] = np.where(k == 1, lgamma(0.5), _LGAMMA[np.maximum(k, 2) - 2])
    b = x[~small]
    out[~small] = (b - 0.5) * np.log(b) - b + 0.5 * log(2 * np.pi) + 1 / (12 * b) - 1 / (360 * b**3)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - 2 * lgamma(0.5)


@dataclass
class Nodes:
    """Bit nodes of one depth: keys (context << 8 | bit prefix), ascending, with counts and stopping weights."""

    key: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    below: np.ndarray  # sum of the children's log P_w
    gamma: np.ndarray | None = None

    def weigh(self, leaf: bool) -> np.ndarray:
        """log P_w of every node; sets ``gamma``."""
        pe = log_kt(self.n0, self.n1)
        if leaf:
            self.gamma = np.ones(len(pe))
            return pe
        pw = np.logaddexp(_HALF + pe, _HALF + self.below)
        self.gamma = np.exp(_HALF + pe - pw)
        return pw

    def at(self, key: np.ndarray) -> np.ndarray:
        """Indices of the keys, -1 where there is none."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[i] == key, i, -1)

    def add_below(self, child_key: np.ndarray, pw: np.ndarray) -> None:
        """Give the children's log P_w to their parents: a child's context has one more, farthest, byte."""
        parent = ((child_key >> 16) << 8) | (child_key & 255)
        np.add.at(self.below, self.at(parent), pw)


def nodes(code: np.ndarray, count: np.ndarray, depth: int, total: int = DEPTH) -> Nodes:
    """The bit nodes at ``depth`` of grams (ascending codes of ``total`` context bytes, nearest first, and the byte)."""
    ctx, sym = code >> (8 * (total - depth + 1)), code & 255
    keys, zeros, ones = [], [], []
    for k in range(8):
        key = (ctx << 8) | (1 << k) | (sym >> (8 - k))
        u, inverse = np.unique(key, return_inverse=True)
        bit = (sym >> (7 - k)) & 1
        keys.append(u)
        zeros.append(np.bincount(inverse, count * (1 - bit), len(u)))
        ones.append(np.bincount(inverse, count * bit, len(u)))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return Nodes(key[order], np.concatenate(zeros)[order], np.concatenate(ones)[order], np.zeros(len(key)))


def weigh(levels: list[Nodes], leaf: bool = True) -> np.ndarray:
    """Weigh levels (shallowest first) from the deepest up; the log P_w of the shallowest."""
    for d in range(len(levels) - 1, -1, -1):
        pw = levels[d].weigh(leaf and d == len(levels) - 1)
        if d:
            levels[d - 1].add_below(levels[d].key, pw)
    return pw


def log10_probability(code: np.ndarray, levels: list[Nodes], total: int = DEPTH) -> np.ndarray:
    """log10 of the probability of each gram's byte in its context; levels: depths 0 to ``total``."""
    out, sym = np.zeros(len(code)), code & 255
    for k in range(8):
        prefix, bit = (1 << k) | (sym >> (8 - k)), (sym >> (7 - k)) & 1
        p, known = np.full(len(code), 0.5), np.zeros(len(code), bool)
        for d in range(total, -1, -1):
            n = levels[d]
            i = n.at(((code >> (8 * (total - d + 1))) << 8) | prefix)
            n0, n1 = (np.where(i >= 0, x[i], 0.0) if len(x) else np.zeros(len(code)) for x in (n.n0, n.n1))
            seen = n0 + n1 > 0
            kt = (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1.0)
            g = np.where(known, n.gamma[i] if len(n.gamma) else 1.0, 1.0)
            p = np.where(seen, g * kt + (1 - g) * p, p)
            known |= seen
        out += np.log10(p)
    return out


def stream(buf: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all grams of the texts with words buf[s:e], in order, the number of each text's grams, and the text of each gram.

    A code holds the ``depth`` context bytes, nearest first, and the byte.
    """
    size, texts = e - s, len(first) - 1
    ends = np.concatenate([[0], np.cumsum(size + 1)])
    each = np.diff(ends[first]) + 1
    base = np.cumsum(each + depth) - each  # of each text, behind the newlines before it
    out = np.full(int(each.sum()) + depth * texts, 0x20, np.int64)
    of_word = np.repeat(np.arange(texts), np.diff(first))
    to = base[of_word] + ends[:-1] - ends[first][of_word]
    out[np.repeat(to - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = buf[np.repeat(s - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    body = np.ones(len(out), bool)
    pads = (base[:, None] - np.arange(1, depth + 1)).ravel()
    body[pads] = False
    out[pads] = out[base + each - 1] = END
    code = np.zeros(len(out), np.int64)
    for k in range(1, depth + 1):
        code <<= 8
        code[depth:] |= out[depth - k : len(out) - k]
    code <<= 8
    code |= out
    return code[body], each, np.repeat(np.arange(texts), each)


def _distinct(code: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending different codes and the sums of their counts (1 each by default)."""
    if count is None:
        code = np.sort(code)
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        return code[at], np.diff(np.append(at, len(code)))
    order = np.argsort(code)
    code, count = code[order], count[order]
    at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[at], np.add.reduceat(count, at) if len(at) else count


class _Merged:
    """Codes and counts of many runs, merged when what is new outweighs what is merged."""

    def __init__(self):
        self.code, self.count, self.new, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, code: np.ndarray, count: np.ndarray) -> None:
        self.new.append((code, count))
        self.size += len(code)
        if self.size > max(len(self.code), MERGED // 4):
            self.merge()

    def merge(self) -> None:
        both = [(self.code, self.count), *self.new]
        self.code, self.count = _distinct(np.concatenate([c for c, _ in both]), np.concatenate([n for _, n in both]))
        self.new, self.size = [], 0

    def take(self, names: list[str]) -> pa.RecordBatch:
        self.merge()
        out = pa.RecordBatch.from_arrays([pa.array(self.code), pa.array(self.count)], names)
        self.__init__()
        return out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """code, c: the grams of runs of texts with their numbers in training texts."""
    held = _Merged()
    for b in batches:
        train = b.column("train").to_numpy(zero_copy_only=False).astype(bool)
        for i, j, buf, offs in K.blocks(b.column("text"), RUN_BYTES):
            low = K.LOWER[buf]
            code, _, of = stream(low, *K.word_spans(low, offs))
            learnt = train[i:j][of]
            held.add(*_distinct(code[learnt]))
            if not learnt.all():
                unseen, _ = _distinct(code[~learnt])
                held.add(unseen, np.zeros(len(unseen), np.int64))
            if len(held.code) >= MERGED:
                yield held.take(["code", "c"])
    yield held.take(["code", "c"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, c: hashes of the words of training texts with their numbers."""
    held = _Merged()
    for b in batches:
        for _, _, buf, offs in K.blocks(b.column("text"), RUN_BYTES):
            low = K.LOWER[buf]
            s, e, _ = K.word_spans(low, offs)
            held.add(*_distinct(K.signed(K.span_hashes(low, s, e))))
            if len(held.code) >= MERGED:
                yield held.take(["h", "c"])
    yield held.take(["h", "c"])


def _all(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray] | None:
    held = [(b.column("code").to_numpy(), b.column("c").to_numpy()) for b in batches if b.num_rows]
    if not held:
        return None
    code, c = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(code)
    return code[order], c[order].astype(float)


def _deep(code: np.ndarray, c: np.ndarray) -> list[Nodes]:
    return [nodes(code, c, d) for d in range(SHALLOW + 1, DEPTH + 1)]


def _shallow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n0, n1, below: shares of the nodes at depth SHALLOW."""
    if held := _all(batches):
        code, c = held
        levels = _deep(code, c)
        pw = weigh(levels)
        top = nodes(code, c, SHALLOW)
        top.add_below(levels[0].key, pw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (top.key, top.n0, top.n1, top.below)], ["key", "n0", "n1", "below"])


def shallow_levels(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> list[Nodes]:
    """Weighed levels 0 to SHALLOW from the nodes at SHALLOW."""
    levels = [Nodes(key, n0, n1, below)]
    for _ in range(SHALLOW):
        deep = levels[0]
        u, back = np.unique(((deep.key >> 16) << 8) | (deep.key & 255), return_inverse=True)
        levels.insert(0, Nodes(u, np.bincount(back, deep.n0, len(u)), np.bincount(back, deep.n1, len(u)), np.zeros(len(u))))
    weigh(levels, leaf=False)
    return levels


def train(grams: DataFrame, ws: Workspace) -> DataFrame:
    """code, c, lp for every row of ``grams`` (code, c): lp is the log10 probability of the gram's byte."""
    spark = grams.sparkSession
    parts = max(1, -(-grams.count() // GRAMS_PER_TASK))
    dealt = grams.repartition(parts, F.shiftright("code", 8 * (DEPTH - SHALLOW)))
    top = dealt.mapInArrow(_shallow, "key long, n0 double, n1 double, below double").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).toPandas().sort_values("key")
    held = spark.sparkContext.broadcast(shallow_levels(*(top[c].to_numpy() for c in ("key", "n0", "n1", "below"))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := _all(batches):
            code, c = got
            deep = _deep(code, c)
            weigh(deep)
            lp = log10_probability(code, [*held.value, *deep])
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(c.astype(np.int64)), pa.array(lp)], ["code", "c", "lp"])

    out = ws.table(dealt.mapInArrow(score, "code long, c long, lp double"), "code-lengths")
    held.destroy()
    return out


@dataclass
class Table:
    """The most frequent entries: ascending keys and values."""

    key: np.ndarray
    values: list[np.ndarray]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Indices, -1 where a key isn't held."""
        if not len(self.key):
            return np.full(len(x), -1, np.int64)
        i = np.minimum(np.searchsorted(self.key, x), len(self.key) - 1)
        return np.where(self.key[i] == x, i, -1)


def _hot(df: DataFrame, key: str, *values: str, n: int) -> Table:
    """At most ``n`` entries: all those whose count is above the least one that keeps to ``n``."""
    held, least = 0, None
    for c, k in sorted(((r["c"], r["k"]) for r in df.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).limit(n).collect()), reverse=True):
        if held + k > n:
            break
        held, least = held + k, c
    p = df.where(F.col("c") >= least if least is not None else F.lit(False)).select(key, *values).toArrow()
    p = {c: p.column(c).to_numpy() for c in (key, *values)}
    order = np.argsort(p[key])
    return Table(p[key][order], [p[v][order] for v in values])


def score(docs: DataFrame, ws: Workspace | None = None, modulus: int = 7, rest: int = 2, hot_words: int = HOT_WORDS, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of ``docs`` (doc_id, text)."""
    spark, ws = docs.sparkSession, ws or Workspace(docs.sparkSession, "context-tree")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id"), modulus, rest))
    learnt = d.where("not held_out").select("text")
    words = ws.table(learnt.mapInArrow(_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    total, known = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = learnt.count()
    n, v = total + ends, known + (ends > 0)
    base_of = lambda c: np.log10((c + 1.0) / (n + v + 1.0))
    grams = ws.table(d.select("text", (~F.col("held_out")).alias("train")).mapInArrow(_grams, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")), "grams")
    lengths = train(grams, ws)
    ws.drop(grams)
    held = spark.sparkContext.broadcast((_hot(words, "h", "c", n=hot_words), _hot(lengths, "code", "lp", n=hot_grams)))
    end_base = log10((ends + 1.0) / (n + v + 1.0))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (of_words, of_grams), part, row = held.value, TaskContext.get().partitionId() << 33, 0
        names = ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "base", "lp", "rare_words", "rare_grams"]
        for b in batches:
            for i, j, buf, offs in K.blocks(b.column("text"), RUN_BYTES):
                low, m = K.LOWER[buf], j - i
                s, e, first = K.word_spans(low, offs)
                size = np.diff(first)
                of = np.repeat(np.arange(m), size)
                h = K.signed(K.span_hashes(low, s, e))
                at = of_words.find(h)
                c = np.where(at >= 0, of_words.values[0][at], 0) if len(of_words.key) else np.zeros(len(h))
                code, each, of_gram = stream(low, s, e, first)
                # in the order of codes, so that the table is read from end to end
                order = np.argsort(code)
                code, of_gram = code[order], of_gram[order]
                to = of_grams.find(code)
                lp = np.where(to >= 0, of_grams.values[0][to], 0.0) if len(of_grams.key) else np.zeros(len(code))
                cols = [
                    np.arange(row, row + m) + part, b.column("doc_id").slice(i, m), b.column("held_out").slice(i, m), size.astype(np.int64) + 1, each.astype(np.int64),
                    np.bincount(of, c > 0, m).astype(np.int64) + (ends > 0), np.bincount(of, np.where(at >= 0, base_of(c), 0.0), m) + end_base, np.bincount(of_gram, lp, m),
                    _rare(h, of, at < 0, m), _rare(code, of_gram, to < 0, m),
                ]
                row += m
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, lp double, rare_words array<long>, rare_grams array<long>"
    t = ws.table(d.mapInArrow(sums, schema), "texts")
    held.destroy()
    cold = t.where("size(rare_words) > 0").select("row", F.explode("rare_words").alias("h")).groupBy("row", "h").agg(F.count("*").alias("k")).join(words, "h", "left")
    c = F.coalesce("c", F.lit(0))
    cold = cold.groupBy("row").agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("k1"), F.sum(F.log10((c + 1.0) / (n + v + 1.0)) * F.col("k")).alias("b1"))
    deep = t.where("size(rare_grams) > 0").select("row", F.explode("rare_grams").alias("code")).groupBy("row", "code").agg(F.count("*").alias("k"))
    deep = deep.join(lengths.select("code", "lp"), "code").groupBy("row").agg(F.sum(F.col("lp") * F.col("k")).alias("l1"))
    out = t.drop("rare_words", "rare_grams").join(cold, "row", "left").join(deep, "row", "left")
    score_ = F.col("lp") + F.coalesce("l1", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k1", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b1", F.lit(0.0))).alias("base_score"), score_.alias("score"), (-score_ / log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _rare(x: np.ndarray, of: np.ndarray, rare: np.ndarray, texts: int) -> pa.Array:
    """For each text those of its values that are rare."""
    at = np.flatnonzero(rare)
    at = at[np.argsort(of[at], kind="stable")]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[at], np.arange(texts + 1)).astype(np.int32)), pa.array(x[at]))
