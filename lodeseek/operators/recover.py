"""Recovery: normalisation, bounded decoding, optical corrections.

Decoding runs level by level on Catalyst expressions. Per record and decoded
text the first way to it counts: the least depth, then the order of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import decode, encoding, ocr
from ..shared import checkpoint_root, small_batches, spread

STEP = "array<struct<operation:string,detail:string,input_sha256:string,output_sha256:string,depth:int,encoding:string,confidence:double>>"


def _step(operation, detail, before, after, depth, enc, confidence):
    return F.struct(operation.alias("operation"), detail.alias("detail"), F.sha2(before, 256).alias("input_sha256"), F.sha2(after, 256).alias("output_sha256"), depth.cast("int").alias("depth"), enc.cast("string").alias("encoding"), confidence.alias("confidence"))


def normalized(records: DataFrame) -> DataFrame:
    """``records`` with ``recovered`` (normalised text), ``steps``, ``depth`` 0 and ``trace_confidence``. Only texts that need it cross to Python."""
    keep = encoding.plain(F.col("text"))
    easy = records.where(keep).withColumn("recovered", F.col("text"))
    hard = records.where(~keep).withColumn("recovered", encoding.normalize_text("text"))
    both = easy.unionByName(hard)
    step = _step(F.lit("normalize"), F.lit("Unicode, escapes and invisible characters"), F.col("text"), F.col("recovered"), F.lit(0), F.lit(None), F.lit(0.98))
    return both.withColumns({"steps": F.when(F.col("recovered") != F.col("text"), F.array(step)).otherwise(F.array().cast(STEP)), "depth": F.lit(0), "trace_confidence": F.col("confidence")})


def decode_levels(level: DataFrame, config: Config = Config()) -> DataFrame:
    """All decodings of ``level`` (record_id, recovered, steps, depth, trace_confidence), itself included, to the depth limit.

    Every level is checkpointed to the shared folder, so that no level is computed again by the next.
    """
    checkpoint_root(level.sparkSession)
    keys = ["record_id", "recovered"]
    level = level.withColumn("ord", F.array().cast("array<int>")).checkpoint()
    seen = frontier = level
    for k in range(1, config.limits.max_decode_depth + 1):
        t = frontier.select("record_id", "recovered", "steps", "trace_confidence", "ord", F.posexplode(decode.tokens(F.col("recovered"))).alias("j", "t"))
        t = t.withColumn("out", decode.decoded(F.col("t.token"), F.col("t.encoding"), config.limits.max_decode_output)).where("out is not null")
        lower = F.greatest(F.lit(0.35), F.col("trace_confidence") - 0.06)
        step = _step(F.lit("decode"), F.concat(F.lit("bounded "), F.col("t.encoding"), F.lit(" decoding")), F.col("t.token"), F.col("out"), F.lit(k), F.col("t.encoding"), lower)
        t = t.select("record_id", F.col("out").alias("recovered"), F.concat("steps", F.array(step)).alias("steps"), F.lit(k).alias("depth"), lower.alias("trace_confidence"), F.concat("ord", F.array("j")).alias("ord"))
        new = t.groupBy(*keys).agg(F.min_by(F.struct("steps", "depth", "trace_confidence", "ord"), "ord").alias("x")).select(*keys, "x.*")
        frontier = new.join(seen.select(*keys), keys, "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.select(*frontier.columns).unionByName(frontier)
    return seen


def ocr_variants(records: DataFrame, rules: list, config: Config = Config()) -> DataFrame:
    """record_id, recovered, edits, rule_id, trace_confidence: corrected texts of image records."""
    limits, width = ocr.constraints(rules), min(config.limits.max_recovery_beam, config.limits.max_ocr_variants)

    frame = lambda rows: pd.DataFrame(rows, columns=["record_id", "recovered", "edits", "rule_id", "trace_confidence"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, size = [], 0
            for i, t, c in zip(b.record_id, b.recovered, b.confidence, strict=True):
                for v, cost, rule in ocr.variants(t, limits, width):
                    rows.append((i, v, cost, rule, max(0.25, c - min(0.5, 0.05 * cost))))
                    size += len(v)
                if size > 8 << 20:
                    yield frame(rows)
                    rows, size = [], 0
            yield frame(rows)

    small_batches(records.sparkSession)
    images = records.where(F.col("carrier_type").isin("image", "pdf-page")).select("record_id", "recovered", "confidence")
    return spread(images).mapInPandas(run, "record_id string, recovered string, edits int, rule_id string, trace_confidence double")


def recover(records: DataFrame, rules: list, config: Config = Config(), recovery: bool = True) -> DataFrame:
    """``records`` with one row for every recovered text: recovered, steps, depth, trace_confidence."""
    if not recovery:
        return records.withColumns({"recovered": F.col("text"), "steps": F.array().cast(STEP), "depth": F.lit(0), "trace_confidence": F.col("confidence")})
    base = normalized(records)
    parts = ["record_id", "recovered", "steps", "depth", "trace_confidence"]
    texts = decode_levels(base.select(*parts), config).select(*parts)
    v = ocr_variants(base, rules, config)
    v = v.select("record_id", "recovered", F.array(_step(F.lit("ocr_substitute"), F.concat(F.lit("beam; rule="), F.col("rule_id")), F.col("record_id"), F.col("recovered"), F.lit(1), F.lit(None), F.col("trace_confidence"))).alias("steps"), F.lit(1).alias("depth"), "trace_confidence")
    return records.join(reduce(DataFrame.unionByName, [texts, v]), "record_id")
