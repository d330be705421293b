"""Verification: one chain of format, checksum, placeholder and context tests, then a score; all Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..rules import CRC_BASE62


def hits(space: Column, terms: tuple[str, ...]) -> Column:
    """The terms that occur in lower-cased ``space``, sorted."""
    return F.filter(F.array(*[F.lit(t.lower()) for t in sorted(set(terms))]), lambda t: F.contains(space, t))


def decide(candidates: DataFrame, config: Config = Config(), post_filter: bool = True) -> DataFrame:
    """``candidates`` with fingerprint, stage (the first test that failed, ``score`` or ``accepted``), score, accepted and the context hits."""
    d, v = config.detection, F.col("value")
    space = F.lower(F.concat_ws(" ", "context", "nested_path", "root_path"))
    c = candidates.withColumn("_space", space).withColumns({"positive": hits(F.col("_space"), config.positive_context), "negative": hits(F.col("_space"), config.negative_context)}).drop("_space")
    full = lambda pattern: F.rlike(v, F.concat(F.lit("^(?:"), pattern, F.lit(r")\z")))
    known = (F.col("checksum") == CRC_BASE62) & F.lower("name").contains("github") & (F.col("format_version").isNull() | (F.col("format_version") == "checksum-v1"))
    stage = (
        F.when(~F.length(v).between(F.col("min_length"), F.col("max_length")), "hard:length")
        .when((F.size("prefixes") > 0) & ~F.exists("prefixes", lambda p: F.startswith(v, p)), "hard:prefix")
        .when(F.col("charset").isNotNull() & ~full(F.col("charset")), "hard:charset")
        .when(F.col("delimiter_pattern").isNotNull() & ~full(F.col("delimiter_pattern")), "hard:delimiter")
        .when(F.col("checksum").isNotNull() & ~(known & T.checksum_ok(v)), "hard:checksum")
        .when(T.placeholder_key(v).isin(sorted({p.lower() for p in config.placeholders})), "hard:placeholder")
        .when(F.col("require_positive_context") & (F.size("positive") == 0), "hard:required-context")
    )
    c = c.withColumns({"_hard": stage, "value_entropy": T.entropy(v)})
    score = F.col("base_score")
    if post_filter:
        score = (
            score
            + F.least(F.lit(0.18), F.size("positive") * d.positive_context_weight)
            + F.when(F.col("field_relation").isNotNull(), d.field_relation_weight).otherwise(0.0)
            - F.least(F.lit(0.18), F.size("negative") * d.negative_context_weight)
            - F.when(T.repeated_filler(v), 0.25).otherwise(0.0)
            + F.when(F.col("value_entropy") >= d.minimum_generic_entropy, 0.08).otherwise(0.0)
            + T.carrier_score(F.col("carrier_type")) * d.carrier_weight
            + (F.col("trace_confidence") - 0.5) * d.recovery_weight
        )
    else:
        score = F.greatest(score, F.lit(d.minimum_score))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    c = c.withColumn("score", F.when(F.col("_hard").isNotNull(), 0.0).otherwise(score))
    c = c.withColumn("stage", F.coalesce("_hard", F.when(F.col("score") < d.minimum_score, "score").otherwise("accepted"))).drop("_hard")
    return c.withColumns({"accepted": F.col("stage") == "accepted", "fingerprint": T.fingerprint(v)})


def findings(decided: DataFrame, config: Config = Config()) -> DataFrame:
    """One finding for each accepted value and place, values masked unless the configuration shows them."""
    best = F.struct(F.col("trace_confidence"), -F.col("rule_seq"))
    f = decided.where("accepted").groupBy("fingerprint", "location_key").agg(
        F.max("score").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("positive")))).alias("positive"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("negative")))).alias("negative"),
        F.max_by(F.struct("value", "name", "rule_id", "provider", "root_path", "nested_path", "location", "carrier_type", "trace_confidence"), best).alias("x"),
    )
    shown = F.col("x.value") if config.detection.show_secrets else T.mask(F.col("x.value"))
    return f.select("fingerprint", "confidence", "positive", "negative", shown.alias("value"), F.col("x.name").alias("credential_type"), "x.rule_id", "x.provider", "x.root_path", "x.nested_path", "x.location", "x.carrier_type", "x.trace_confidence")


def ranked(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("confidence"), "root_path", "fingerprint", "location")
