"""The whole scan: records to recovered texts, candidates, decisions, findings and a report."""

from __future__ import annotations

import datetime
import json
import platform
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..rules import CORE_RULES, Rule, ordered, stable_hash
from . import extract, recover, related, verify

# --- fixed values: stages that an ablation switches off ---
PROFILES = {"full": {}, "no-media": {"media": False}, "no-recovery": {"recovery": False}, "no-post-filter": {"post_filter": False}}
MEDIA = ("image", "pdf-page", "audio", "video")
# --- end of fixed values ---


@dataclass
class Scan:
    records: DataFrame
    candidates: DataFrame  # before deduplication
    decisions: DataFrame
    findings: DataFrame
    warnings: DataFrame


def scan(records: DataFrame, rules: list[Rule] | None = None, config: Config = Config(), profile: str = "full", case_sensitive: bool = True, group_mode: str = "whole", proposed: DataFrame | None = None) -> Scan:
    """Find credentials in text records; ``proposed`` may hold recovery plans (group_id, plan)."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    switches, rules = PROFILES[profile], ordered(rules if rules is not None else CORE_RULES)
    if not switches.get("media", True):
        records = records.where(~F.col("carrier_type").isin(*MEDIA))
    texts = recover.recover(records, rules, config, switches.get("recovery", True))
    found, late = extract.extract(texts, rules, config, case_sensitive, group_mode)
    if switches.get("recovery", True):
        more, late2 = extract.extract(_fragments(records, rules, config), rules, config, case_sensitive, group_mode)
        found, late = found.unionByName(more), late.unionByName(late2)
        if proposed is not None:
            g = related.groups(records, of=proposed)
            p = related.plans(g, proposed, config)
            late = late.unionByName(p.where("error is not null").select(F.lit("recovery_plan_rejected").alias("code"), F.col("group_id").alias("path"), F.col("error").alias("message")))
            synthetic = p.where("value is not null").join(g.drop("confidence"), "group_id").withColumns({"text": F.col("value")})
            cols = {c: F.lit(None).cast("string") for c in ("field_path", "encoding", "mime", "parent_id")}
            synthetic = synthetic.withColumns(cols | {"record_id": F.concat(F.lit("P:"), "group_id"), "nested_path": F.col("members")[0]["nested_path"], "carrier_type": F.lit("recovery-plan"), "location": F.array_join(F.transform("members", lambda m: m["location"]), " + "), "context": F.array_join(F.transform("members", lambda m: m["context"]), " "), "grp": F.col("group_id"), "relationship": F.col("relation"), "byte_offset": F.lit(None).cast("long"), "page": F.lit(None).cast("int"), "detected_type": F.lit("recovery-plan"), "content_sha256": F.sha2("value", 256)})
            more, late3 = extract.extract(recover.recover(synthetic.select(*records.columns), rules, config, False), rules, config, case_sensitive, group_mode)
            found, late = found.unionByName(more), late.unionByName(late3)
    decisions = verify.decide(extract.deduplicated(found), config, switches.get("post_filter", True))
    return Scan(records, found, decisions, verify.findings(decisions, config), late)


def _fragments(records: DataFrame, rules: list[Rule], config: Config) -> DataFrame:
    return recover.recover(related.fragments(related.groups(related.fragmented(records))), rules, config, False)


def ablation(records: DataFrame, rules: list[Rule] | None = None, config: Config = Config()) -> DataFrame:
    """profile, candidates, accepted for every profile, as ``scan`` gives them.

    Texts are recovered and searched once with and once without recovery: profiles differ in which of these candidates they take, and in fragments.
    """
    rules, out, own, joined = ordered(rules if rules is not None else CORE_RULES), None, {}, {}
    for name, switches in PROFILES.items():
        recovery, media, post = (switches.get(x, True) for x in ("recovery", "media", "post_filter"))
        if recovery not in own:
            own[recovery] = extract.extract(recover.recover(records, rules, config, recovery), rules, config)[0]
        kept = lambda df: df if media else df.where(~F.col("carrier_type").isin(*MEDIA))
        found = kept(own[recovery])
        if recovery:
            if media not in joined:
                joined[media] = extract.extract(_fragments(kept(records), rules, config), rules, config)[0]
            found = found.unionByName(joined[media])
        decisions = verify.decide(extract.deduplicated(found), config, post)
        row = decisions.agg(F.count("*").alias("candidates"), F.coalesce(F.sum(F.col("accepted").cast("int")), F.lit(0)).alias("accepted")).select(F.lit(name).alias("profile"), "candidates", "accepted")
        out = row if out is None else out.unionByName(row)
    return out


def summary(s: Scan) -> DataFrame:
    """One row of counts: records, raw_candidates, duplicate_candidates, decided, accepted, findings."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    c = one(s.records, "records").crossJoin(one(s.candidates, "raw_candidates")).crossJoin(s.decisions.agg(F.count("*").alias("decided"), F.coalesce(F.sum(F.col("accepted").cast("int")), F.lit(0)).alias("accepted"))).crossJoin(one(s.findings, "findings"))
    return c.withColumn("duplicate_candidates", F.col("raw_candidates") - F.col("decided"))


def warnings_by_code(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("code").agg(F.count("*").alias("n"))


def write_findings(s: Scan, path: str) -> None:
    """Redacted findings as JSON lines, written by the executors."""
    verify.ranked(s.findings).write.mode("overwrite").json(path)


def report(s: Scan, target: str, config: Config = Config(), rules: list[Rule] | None = None, limit: int = 10_000) -> dict:
    """A JSON-ready report: counts, the first ``limit`` findings, warnings by code, provenance."""
    rules = ordered(rules if rules is not None else CORE_RULES)
    shown = verify.ranked(s.findings).limit(limit).toJSON().collect()
    return {
        "schema_version": "2.0", "target": target, "generated_at": datetime.datetime.now(datetime.UTC).isoformat(), "summary": summary(s).first().asDict(), "findings": [json.loads(x) for x in shown],
        "warnings": {r["code"]: r["n"] for r in warnings_by_code(s.warnings).collect()},
        "provenance": {"config_sha256": stable_hash(config.as_dict()), "rules_sha256": stable_hash([(r.id, r.pattern) for r in rules]), "python": platform.python_version(), "platform": platform.platform()},
    }
