"""Structured Streaming: the stateless stages on a stream of texts, duplicates dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..operators.verify import decide
from ..rules import CORE_RULES, Rule, rules_frame, to_java
from ..operators import extract


#: Characters on each side of a match that are its context, as in the batch scan.
AROUND = 120


def _hits(text: Column, rule: Rule, seq: int) -> Column:
    """rule_seq, value and context of every match: the parts between the matches give their places."""
    pattern = F.lit(to_java(rule.pattern))
    whole, parts = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    steps = F.arrays_zip(whole.alias("m"), F.slice(parts, 1, F.size(whole)).alias("p"), extract.values(text, rule).alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<rule_seq:int,value:string,context:string>>").alias("hits"))

    def step(done: Column, x: Column) -> Column:
        at = done.at + F.length(x.p)
        end, first = at + F.length(x.m), F.greatest(at - AROUND, F.lit(0))
        hit = F.struct(F.lit(seq).alias("rule_seq"), x.v.alias("value"), F.substring(text, first + 1, end + AROUND - first).alias("context"))
        return F.struct(end.alias("at"), F.concat(done.hits, F.array(hit)).alias("hits"))

    return F.aggregate(steps, start, step, lambda done: done.hits)


def findings(texts: DataFrame, root, nested, text, at: str, rules: tuple[Rule, ...] = CORE_RULES, config: Config = Config(), delay: str = "10 minutes") -> DataFrame:
    """Accepted values of a stream: fingerprint, root_path, nested_path, rule_id, score, masked value and time.

    Values come from Java's engine, so they carry no spans. A value at one place counts once within the watermark ``delay`` of column ``at``.
    """
    base = texts.select(F.col(at).alias("at"), root.alias("root_path"), nested.alias("nested_path"), text.alias("_t")).withWatermark("at", delay)
    base = base.where(extract.prefilter(F.col("_t"), list(rules)))
    hits = F.array_distinct(F.flatten(F.array(*[_hits(F.col("_t"), r, k) for k, r in enumerate(rules)])))
    c = base.select("at", "root_path", "nested_path", F.explode(hits).alias("h")).select("at", "root_path", "nested_path", "h.*")
    frame = rules_frame(texts.sparkSession, list(rules)).withColumnRenamed("seq", "rule_seq").drop("pattern", "pattern_sha256")
    c = c.join(F.broadcast(frame), "rule_seq")
    c = c.withColumns({"carrier_type": F.lit("text"), "trace_confidence": F.lit(0.95), "field_relation": F.lit(None).cast("string")})
    out = decide(c, config).where("accepted")
    out = out.select("at", "fingerprint", "root_path", "nested_path", "rule_id", "score", T.mask(F.col("value")).alias("value"))
    return out.dropDuplicatesWithinWatermark(["fingerprint", "root_path", "nested_path"])
