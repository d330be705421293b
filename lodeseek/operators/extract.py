"""Candidate extraction: native prefilter, then spans by the ``regex`` engine, then native gates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..rules import Rule, rules_frame, to_java, to_regex
from ..shared import checkpoint_root, small_batches

#: What a record hands on to its candidates.
PLACE = ("record_id", "root_path", "nested_path", "carrier_type", "record_context", "relationship", "field_path", "depth", "trace_confidence", "steps_sha256")
SPAN = "record_id string, root_path string, nested_path string, carrier_type string, record_context string, relationship string, field_path string, depth int, trace_confidence double, steps_sha256 string, rule_seq int, value string, location string, local_context string"


def prefilter(text: Column, rules: list[Rule], case_sensitive: bool = True) -> Column:
    """Whether any rule can match: it holds one of the rule's keywords or literals, or some rule has none."""
    words = {(w, case_sensitive) for r in rules for w in r.keywords} | {(w, True) for r in rules if not r.keywords for w in r.literals}
    if any(not r.keywords and not r.literals for r in rules) or not words:
        return F.lit(True)
    low = F.lower(text)
    return reduce(or_, [text.contains(w) if exact else low.contains(w.lower()) for w, exact in sorted(words)])


def _span_finder(rules: list[Rule], config: Config, case_sensitive: bool, group_mode: str):
    import regex

    limits, seconds = config.limits, config.detection.max_regex_seconds
    compiled: list = []

    def compile_all() -> None:
        for k, r in enumerate(rules):
            allow = [(t, regex.compile(to_regex(p))) for t, p in r.allow_regexes]
            paths = [regex.compile(to_regex(p)) for p in r.allow_paths]
            stop = regex.compile(r"\L<w>", w=[s.casefold() for s in r.stopwords]) if r.stopwords else None
            compiled.append((k, r, regex.compile(to_regex(r.pattern)), allow, paths, stop))

    def allowed(value: str, whole: str, path: str, allow: list, paths: list, stop) -> bool:
        if stop is not None and stop.search(value.casefold()):
            return True
        target = {"secret": value, "match": whole, "line": whole, "path": path}
        return any(p.search(target.get(t, value)) for t, p in allow) or any(p.search(path) for p in paths)

    frame = lambda rows: pd.DataFrame(rows, columns=[c.split()[0] for c in SPAN.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not compiled:
            compile_all()
        for b in batches:
            rows, size = [], 0
            for x in b.itertuples(index=False):
                if size > 8 << 20:
                    yield frame(rows)
                    rows, size = [], 0
                text, path = x.recovered, f"{x.root_path}!/{x.nested_path}"
                place = tuple(getattr(x, c) for c in PLACE)
                low = None if case_sensitive else text.lower()
                for k, r, pattern, allow, paths, stop in compiled:
                    if r.keywords and not any(w in text if case_sensitive else w.lower() in low for w in r.keywords):
                        continue
                    try:
                        found = []
                        for m in pattern.finditer(text, timeout=seconds):
                            if len(found) == limits.max_rule_matches:
                                rows.append((*place, k, None, f"more than {limits.max_rule_matches} matches", None))
                                break
                            found.append(m)
                    except TimeoutError:
                        rows.append((*place, k, None, "regex timeout", None))
                        continue
                    for m in found:
                        g = r.secret_group or (1 if group_mode == "first_group" and m.re.groups else 0)
                        value = m[g]
                        if value is None or allowed(value, m[0], path, allow, paths, stop):
                            continue
                        rows.append((*place, k, value, f"{x.location}@{m.start(g)}:{m.end(g)}", text[max(0, m.start() - 120) : m.end() + 120]))
                        size += len(value) + m.end() - m.start() + 1000
            yield frame(rows)

    return run


def extract(recovered: DataFrame, rules: list[Rule], config: Config = Config(), case_sensitive: bool = True, group_mode: str = "whole") -> tuple[DataFrame, DataFrame]:
    """(candidates, warnings) of recovered texts. Candidates carry their record's place and their rule's constraints.

    The matches are checkpointed to the shared folder: they are few, and decisions, findings, counts and warnings all read them.
    """
    spark = recovered.sparkSession
    checkpoint_root(spark)
    small_batches(spark)
    texts = recovered.where(prefilter(F.col("recovered"), rules, case_sensitive))
    texts = texts.withColumns({"steps_sha256": F.sha2(F.to_json("steps"), 256), "record_context": F.col("context")})
    spans = texts.select(*PLACE, "location", "recovered").mapInPandas(_span_finder(rules, config, case_sensitive, group_mode), SPAN).checkpoint()
    frame = F.broadcast(rules_frame(spark, rules).withColumnRenamed("seq", "rule_seq").drop("pattern", "pattern_sha256"))  # a few hundred rows
    c = spans.join(frame, "rule_seq")
    late = c.where("value is null").select(F.lit("rule_runtime_error").alias("code"), F.col("rule_id").alias("path"), F.concat_ws(": ", "nested_path", "location").alias("message"))
    c = c.where("value is not null").where(F.col("entropy").isNull() | (T.entropy(F.col("value")) >= F.col("entropy")))
    # the record's place and the rule's constraints go with the candidate, so that it can be verified by itself
    context = F.concat_ws(" ", F.nullif("record_context", F.lit("")), F.nullif("local_context", F.lit("")))
    relation = F.coalesce("relationship", F.when(F.col("field_path") != "", "field"))
    return c.withColumns({"context": context, "field_relation": relation, "location_key": F.concat_ws("\0", "root_path", "nested_path", "location")}).drop("record_context", "local_context", "relationship", "field_path"), late


def values(text: Column, rule: Rule) -> Column:
    """The rule's values in ``text`` by Java's engine, without spans: for operators that need no places."""
    return F.regexp_extract_all(text, F.lit(to_java(rule.pattern)), F.lit(rule.secret_group))


def deduplicated(candidates: DataFrame) -> DataFrame:
    """One candidate for each value and place: a core rule's before others, else the first by rule order; its sources are those of all."""
    key = W.partitionBy("value", "location_key")
    first = key.orderBy(F.col("provider") != "core", "rule_seq", "depth")
    sources = F.sort_array(F.collect_set(F.concat_ws("/", "provider", "rule_id")).over(key))
    return candidates.withColumns({"matched_rule_sources": sources, "_n": F.row_number().over(first)}).where("_n = 1").drop("_n")
