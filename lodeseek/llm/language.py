"""Language identification by string kernels.

A text is the set of its byte n-grams of lengths 1 to 3 (a blended spectrum,
presence only), hashed to ``FEATURES`` bits. The kernel of two texts is the
cosine of their sets. Some training texts are landmarks; kernel values against
them, whitened, are Nystroem features, and one-versus-rest kernel ridge
regression is fitted on these in closed form. Prediction is two matrix products
a batch: texts by landmarks, then landmarks by languages.

The classifier learns from a bounded sample, at most ``PER_CLASS`` labelled
texts of a language and ``MAX_CLASSES`` languages, by hash order of ids; a
text's features are one bit set however long it is. Prediction reads every
whole text once, within its row.

Edge cases. Null texts and texts without a letter are ``und`` with score 0, and
so is everything if there is nothing to learn from. Null ids aren't learned
from and aren't held out. Rows that repeat an id are judged one by one. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .store import small_batches

FEATURES_LOG2 = 13
FEATURES = 1 << FEATURES_LOG2
PER_CLASS, MAX_CLASSES, LANDMARKS = 400, 200, 128
RIDGE = 1e-2
UND = "und"
#: A name for columns within the operator that no table is taken to have.
FRESH = "lodeseek_"
_ASCII_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def presence(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """texts x FEATURES: 1 where the text has an n-gram of the feature."""
    n = len(offs) - 1
    x = np.zeros(n * FEATURES, np.uint8)
    if len(buf):
        low = K.LOWER[buf]
        low[K.SPACE[low]] = 32
        row = np.repeat(np.arange(n, dtype=np.int64) * FEATURES, np.diff(offs))
        left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(buf))
        code = low.astype(np.uint32)
        gram = code.copy()
        for k in range(3):
            if k:
                gram = gram[:-1] * np.uint32(257) + code[k:] + np.uint32(k)
            ok = left[: len(gram)] > k
            h = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURES_LOG2)
            x[(row[: len(gram)] + h)[ok]] = 1
    return x.reshape(n, FEATURES)


def has_letter(text: str | None, raw: np.ndarray) -> bool:
    return bool(text) and (bool(_ASCII_LETTER[raw].any()) or any(c.isalpha() for c in text))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # LANDMARKS x FEATURES, rows of length 1
    weights: np.ndarray  # LANDMARKS x languages

    def scores(self, x: np.ndarray) -> np.ndarray:
        """texts x languages, 0 to 1."""
        k = x.astype(np.float32) @ self.landmarks.T
        k /= np.sqrt(np.maximum(x.sum(1, dtype=np.float32), 1.0))[:, None]
        return np.clip((k @ self.weights + 1) / 2, 0, 1)


def fit(x: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """x: texts x FEATURES presence; labels: one language for each."""
    languages = sorted(set(labels))
    if not languages:
        return None
    unit = x.astype(np.float32) / np.sqrt(np.maximum(x.sum(1, dtype=np.float32), 1.0))[:, None]
    of = np.array([languages.index(v) for v in labels])
    rank = np.zeros(len(of), np.int64)
    for k in range(len(languages)):
        rank[of == k] = np.arange((of == k).sum())
    marks = unit[np.argsort(rank, kind="stable")[:landmarks]]  # every language in turn
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    whiten = vector / np.sqrt(np.maximum(value, 1e-6))
    phi = (unit @ marks.T).astype(np.float64) @ whiten
    y = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1.0 / np.bincount(of, minlength=len(languages))[of]
    a = (phi * weight[:, None]).T @ phi + ridge * np.eye(phi.shape[1])
    w = np.linalg.solve(a, (phi * weight[:, None]).T @ y)
    return Model(languages, marks, (whiten @ w).astype(np.float32))


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def learn(docs: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Fit on at most ``per_class`` texts of each language of ``docs`` (doc_id, text, lang), all of which may be learned from."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and doc_id is not null")
    counts = d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_CLASSES).collect()
    if not counts:
        return None
    share = [(r["lang"], min(1.0, 1.5 * per_class / r["count"] + 32 / r["count"])) for r in counts]
    shares = d.sparkSession.createDataFrame(share, "lang string, share double")
    d = d.join(F.broadcast(shares), "lang").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)).where("at < share")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(r).tobytes() for _, _, buf, offs in K.blocks(b.column("text")) for r in presence(buf, offs)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("at"), pa.array(bits, pa.binary())], ["lang", "at", "bits"])

    rows = d.select("lang", "at", "text").mapInArrow(pack, "lang string, at double, bits binary").toPandas().sort_values(["lang", "at"])
    rows = rows.groupby("lang").head(per_class)
    x = np.array([np.unpackbits(np.frombuffer(b, np.uint8)) for b in rows["bits"]], np.uint8).reshape(-1, FEATURES)
    return fit(x, list(rows["lang"]))


def predict(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` (with text), lang_pred and score; ``keep`` must not hold these two names."""
    small_batches(docs.sparkSession)
    if clash := {c.lower() for c in keep} & {"lang_pred", "score"}:
        raise ValueError(f"columns {sorted(clash)} are named like results; use spoken() or rename them")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            names, scores = [], []
            texts = b.column(len(keep))
            for i, _, buf, offs in K.blocks(texts):
                s = model.scores(presence(buf, offs)) if model else None
                for r in range(len(offs) - 1):
                    raw = buf[offs[r] : offs[r + 1]]
                    if s is None or not len(raw) or not has_letter(texts[i + r].as_py() if not _ASCII_LETTER[raw].any() else "a", raw):
                        names.append(UND)
                        scores.append(0.0)
                    else:
                        k = int(s[r].argmax())
                        names.append(model.languages[k])
                        scores.append(float(s[r, k]))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    quoted = ["`" + c.replace("`", "``") + "`" for c in keep]
    d = docs.select(*quoted, F.col("text").cast("string").alias(FRESH))
    schema = ", ".join(f"{q} {f.dataType.simpleString()}" for q, f in zip(quoted, d.schema.fields, strict=False))
    return d.mapInArrow(run, f"{schema}, lang_pred string, score double")


def spoken(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` (text, any further columns) whose language can be told, with the columns that they have."""
    names = [f"{FRESH}{k}" for k in range(len(docs.columns))]
    at = docs.columns.index("text")
    d = docs.toDF(*names).withColumn("text", F.col(names[at]))
    return predict(d, model, *names).where(F.col("lang_pred") != UND).select(*names).toDF(*docs.columns)


def identify(docs: DataFrame, modulus: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), modulus, rest))
    return predict(d, learn(d.where("not held_out")), "doc_id", "held_out")
