"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon holds words that occur in toxic training texts of several unlike
kinds (texts are told apart by a min-hash, so copies count once) and hardly in
others. Its terms form a trie. A word of a text matches exactly by hash; other
words that keep a whole part of a term in place (with k edits and k + 1 parts,
one part is untouched) are run through a Levenshtein automaton intersected with
the trie. Terms that clean texts often come near to are matched exactly only. Each
hit is weighed by its context window: quotation marks around it and verbs of
speaking before it speak for quotation, second-person words near it for abuse. A logistic regression over a text's hit totals gives the score.

Labels are learned from a bounded sample, about ``PER_LABEL`` texts of each
label by hash order of ids, and the lexicon has at most ``MAX_TERMS`` terms.
Scoring reads every whole text once, within its row.

Edge cases. Null and empty texts have no hits and get the score of such texts.
With labels of one kind or none, every score is 0. Null ids aren't learned from
and aren't held out. Ids labelled more than once count with their highest
label. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .language import held_out
from .store import Workspace, small_batches

PER_LABEL, MAX_TERMS, MIN_GROUPS, MIN_PRECISION, MIN_G2 = 6000, 4000, 3, 0.9, 24.0
MIN_LENGTH = 4
#: Shortest terms that are matched within one and within two edits.
ONE_EDIT, TWO_EDITS = 5, 9
WINDOW = 6
WORD = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")) | (np.arange(256) >= 0x80)
#: Words that introduce quotations, and words that address a person.
SAYING = frozenset("said says say saying wrote writes quote quoted called calls word term told reads sagte sagt schrieb wort zitat dit disait mot écrit dijo dice palabra escribió".split())
ADDRESS = frozenset("you your you're youre u ur yourself du dich dir dein deine ihr euch tu te toi vous votre ton tú usted ustedes vos eres".split())
#: Share of clean training texts with a near hit from which a term is matched exactly only, and texts looked at for it.
NEAR_CLEAN, NEAR_TEXTS = 0.002, 1500
QUOTES = "\"'“”„«»‘’`"
FEATURES = 4


class Levenshtein:
    """The automaton that accepts strings within ``k`` edits of ``word``; states are tuples of (position, edits)."""

    def __init__(self, word: str, k: int):
        self.word, self.k = word, k

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((i, i) for i in range(min(self.k, len(self.word)) + 1))

    def step(self, state: tuple[tuple[int, int], ...], c: str) -> tuple[tuple[int, int], ...]:
        best: dict[int, int] = {}
        for i, e in state:
            moves = [(i, e + 1)]  # c was added
            if i < len(self.word):
                moves.append((i + 1, e + (self.word[i] != c)))
            for j, f in moves:
                while f <= self.k and f < best.get(j, self.k + 1):
                    best[j] = f
                    if j >= len(self.word):
                        break
                    j, f = j + 1, f + 1  # a letter was left out
        return tuple(sorted(best.items()))

    def edits(self, state: tuple[tuple[int, int], ...]) -> int | None:
        return min((e for i, e in state if i == len(self.word)), default=None)


class Trie:
    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for t in terms:
            at = self.root
            for c in t:
                at = at.setdefault(c, {})
            at[""] = t

    def within(self, word: str, k: int) -> tuple[int, str] | None:
        """(edits, term) of the nearest term within ``k`` edits that its length allows; the smallest at ties."""
        a, best = Levenshtein(word, k), None
        stack = [(self.root, a.start())]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    e = a.edits(state)
                    if e is not None and e <= allowed_edits(child) and (best is None or (e, child) < best):
                        best = (e, child)
                elif nxt := a.step(state, c):
                    stack.append((child, nxt))
        return best


def allowed_edits(term: str) -> int:
    return (len(term) >= ONE_EDIT) + (len(term) >= TWO_EDITS)


@dataclass
class Lexicon:
    """Terms with weights, and the hash tables by which words of a text are preselected."""

    weight: dict[str, float]
    exact_only: frozenset[str] = frozenset()
    trie: Trie = field(init=False)

    def __post_init__(self):
        loose = [t for t in self.weight if t not in self.exact_only and allowed_edits(t)]
        self.trie = Trie(loose)
        pairs = sorted((K.hash_of(t.encode()), t) for t in self.weight)
        self.exact = np.array([h for h, _ in pairs], K.U64)
        self.named = [t for _, t in pairs]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.exact & K.U64(0xFFFF)).astype(np.int64)] = True
        parts: dict[tuple[int, int, int], set[int]] = {}  # (anchor: 0 start, 1 end, 2 middle; offset; bytes) -> hashes
        lengths: dict[tuple[int, int, int], list[int]] = {}
        for t in loose:
            k = allowed_edits(t)
            cuts = [round(len(t) * i / (k + 1)) for i in range(k + 2)]
            pieces = [t[a:b].encode() for a, b in zip(cuts, cuts[1:], strict=False)]
            size = len(t.encode())
            keys = [((0, 0, len(pieces[0])), pieces[0]), ((1, 0, len(pieces[-1])), pieces[-1])]
            if k == 2:
                keys += [((2, len(pieces[0]) + d, len(pieces[1])), pieces[1]) for d in range(-2, 3)]
            for key, piece in keys:
                parts.setdefault(key, set()).add(K.hash_of(piece))
                lo, hi = lengths.get(key, [size, size])[0], lengths.get(key, [size, size])[-1]
                lengths[key] = [min(lo, size - 2 * k), max(hi, size + 4 * k)]
        self.parts = [(key, np.array(sorted(h), K.U64), lengths[key]) for key, h in parts.items()]
        self._seen: dict[bytes, tuple[int, str] | None] = {}

    def __getstate__(self):
        return self.weight, self.exact_only

    def __setstate__(self, state):
        self.weight, self.exact_only = state
        self.__post_init__()

    def preselect(self, spans: K.Spans, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of words that are terms, and of other words that may be near one."""
        hit = np.flatnonzero(self.maybe[(h & K.U64(0xFFFF)).astype(np.int64)])
        exact = hit[np.isin(h[hit], self.exact)] if len(hit) else hit
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        us, ue = s[first], e[first]
        size, near = ue - us, np.zeros(len(first), bool)
        for (anchor, off, n), hashes, (lo, hi) in self.parts:
            at = np.flatnonzero((size >= max(n + (off if anchor == 2 else 0), lo)) & (size <= hi) & ~near)
            if len(at):
                a = us[at] + off if anchor != 1 else ue[at] - n
                near[at[np.isin(spans(a, a + n), hashes)]] = True
        near[back[exact]] = False
        return exact, np.flatnonzero(near[back])

    def near(self, word: bytes) -> tuple[int, str] | None:
        if word not in self._seen:
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[word] = self.trie.within(word.decode("utf-8", "replace"), 2)
        return self._seen[word]


def context(text: bytes, before: list[bytes], after: list[bytes], start: int, end: int) -> tuple[float, float]:
    """(quotation, address), 0 to 1 each, for the hit text[start:end] between the words of its window."""
    left, right = text[max(0, start - 80) : start].decode("utf-8", "ignore"), text[end : end + 80].decode("utf-8", "ignore")
    marks = any(c in QUOTES for c in left[-40:]) and any(c in QUOTES for c in right[:40])
    tight = bool(left) and left[-1] in QUOTES and bool(right) and (right[0] in QUOTES or right[1:2] in tuple(QUOTES))
    said = any(w.decode("utf-8", "ignore") in SAYING for w in before)
    to = any(w.decode("utf-8", "ignore") in ADDRESS for w in before + after)
    return min(1.0, 0.5 * tight + 0.3 * marks + 0.4 * said), float(to)


def features(lex: Lexicon, texts: pa.Array) -> np.ndarray:
    """texts x FEATURES: weighed hits, strongest hit, quoted hits, hits in address."""
    out = np.zeros((len(texts), FEATURES))
    for row, term, edits, quote, to in hits(lex, texts):
        x = lex.weight[term] * (1 - 0.8 * quote) * (1 + 0.5 * to) * 0.7**edits
        f = out[row]
        f[0] += x
        f[1] = max(f[1], x)
        f[2] += quote
        f[3] += to * (1 - quote)
    return np.log1p(out)


def hits(lex: Lexicon, texts: pa.Array) -> Iterator[tuple[int, str, int, float, float]]:
    """(row, term, edits, quotation, address) of every hit."""
    for i, _, buf, offs in K.blocks(texts):
        low = K.LOWER[buf]
        s, e, first = K.word_spans(low, offs, WORD)
        if not len(s):
            continue
        spans = K.Spans(low)
        exact, near = lex.preselect(spans, s, e, spans(s, e))
        raw = low.tobytes()
        found = [(int(w), lex.named[int(np.searchsorted(lex.exact, spans(s[w : w + 1], e[w : w + 1])[0]))], 0) for w in exact]
        for w in near:
            if m := lex.near(raw[s[w] : e[w]]):
                found.append((int(w), m[1], m[0]))
        for w, term, edits in found:
            d = int(np.searchsorted(first, w, side="right")) - 1
            lo, hi = max(int(first[d]), w - WINDOW), min(int(first[d + 1]), w + WINDOW + 1)
            o = int(offs[d])
            quote, to = context(raw[o : offs[d + 1]], [raw[s[k] : e[k]] for k in range(lo, w)], [raw[s[k] : e[k]] for k in range(w + 1, hi)], int(s[w]) - o, int(e[w]) - o)
            yield i + d, term, edits, quote, to


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # FEATURES and a constant

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = features(self.lexicon, texts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def regress(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; share: the weight of each row."""
    x = np.column_stack([x, np.ones(len(x))])
    w, pull = np.zeros(x.shape[1]), ridge * np.array([*[1.0] * (x.shape[1] - 1), 0.01])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (y - p)) - pull * w
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.diag(pull), g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, word, toxic, kind: each different word of each text, with the text's min-hash."""
    for b in batches:
        toxic = b.column("toxic").to_numpy(zero_copy_only=False)
        for i, _, buf, offs in K.blocks(b.column("text")):
            low = K.LOWER[buf]
            s, e, first = K.word_spans(low, offs, WORD)
            h = K.span_hashes(low, s, e)
            raw, cols = low.tobytes(), [[], [], [], []]
            for d in range(len(offs) - 1):
                u, at = np.unique(h[first[d] : first[d + 1]], return_index=True)
                if not len(u):
                    continue
                at = at + first[d]
                ok = (e[at] - s[at] >= MIN_LENGTH) & (e[at] - s[at] <= 40)
                cols[0].append(K.signed(u[ok]))
                cols[1] += [raw[s[k] : e[k]].decode("utf-8", "replace") for k in at[ok]]
                cols[2].append(np.full(ok.sum(), toxic[i + d], np.int32))
                cols[3].append(np.full(ok.sum(), K.signed(K.mix(u).min(keepdims=True))[0]))
            if cols[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols[0])), pa.array(cols[1], pa.string()), pa.array(np.concatenate(cols[2])), pa.array(np.concatenate(cols[3]))], ["h", "word", "toxic", "kind"])


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """Fit on at most ``per_label`` texts of each label; ``docs`` (doc_id, text) holds only ids that may be learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, per_label / counts[1])).otherwise(min(1.0, per_label / counts[0]))
    picked = known.where(at < share)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = Workspace(spark, "toxicity").table(rows, "sample")  # a bounded number of texts that four passes read
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    seen = rows.select("text", "toxic").mapInArrow(_words, "h long, word string, toxic int, kind long").groupBy("h", "toxic", "kind").agg(F.min("word").alias("word"))
    seen = seen.groupBy("h").agg(F.min("word").alias("word"), F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    seen = seen.where(F.col("t") >= max(MIN_GROUPS, n[1] // 2000))
    rate_t, rate_c = (F.col("t") + 0.5) / (n[1] + 1.0), (F.col("c") + 0.5) / (n[0] + 1.0)
    seen = seen.withColumn("p", rate_t / (rate_t + rate_c)).where(F.col("p") >= MIN_PRECISION)
    # more than chance, among some 100,000 words that are looked at (log-likelihood ratio)
    prior, both = n[1] / (n[0] + n[1]), F.col("t") + F.col("c")
    g2 = 2 * (F.col("t") * F.log(F.col("t") / (both * prior)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (both * (1 - prior)))).otherwise(0.0))
    seen = seen.where(g2 >= MIN_G2)
    terms = seen.orderBy(F.desc(F.col("t") * F.col("p")), "word").limit(MAX_TERMS).collect()
    lex = Lexicon({r["word"]: math.log(r["p"] / (1 - r["p"])) for r in terms})
    held = spark.sparkContext.broadcast(lex)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = sorted({(row, term) for row, term, edits, _, _ in hits(held.value, b.column("text")) if edits})
            yield pa.RecordBatch.from_arrays([pa.array([t for _, t in pairs], pa.string())], ["term"])

    clean = rows.where(F.col("toxic") == 0).where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, NEAR_TEXTS / n[0])))
    often = clean.select("text").mapInArrow(near, "term string").groupBy("term").count().where(F.col("count") > NEAR_CLEAN * min(n[0], NEAR_TEXTS)).collect()
    lex = Lexicon(lex.weight, frozenset(r["term"] for r in often))
    held = spark.sparkContext.broadcast(lex)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(held.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array(x[:, k]) for k in range(FEATURES))], ["toxic", *(f"x{k}" for k in range(FEATURES))])

    m = rows.select("text", "toxic").mapInArrow(measure, "toxic int, " + ", ".join(f"x{k} double" for k in range(FEATURES))).toPandas()
    m = m.sort_values(list(m.columns))
    y = m["toxic"].to_numpy(float)
    return Model(lex, regress(m.drop(columns="toxic").to_numpy(float), y, np.ones(len(y))))


def detect(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); labels (doc_id, toxic)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id"), modulus, rest))
    model = learn(d.where("not held_out"), labels.where(~held_out(F.col("doc_id"), modulus, rest)))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = held.value.scores(b.column("text")) if held.value else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return d.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
