"""Command line: scan, capabilities, rules audit, benchmark."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import load
from .operators import evaluate
from .operators.scan import PROFILES, report, scan
from .rules import CORE_RULES, audit, load_snapshot, ordered
from .sources.detect import capabilities
from .sources.localize import files, localize


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodeseek")
    p.add_argument("--config")
    p.add_argument("--rules", help="a TOML rule snapshot to use beside the core rules")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("target")
    s.add_argument("--output", "-o", default="-")
    s.add_argument("--profile", choices=sorted(PROFILES), default="full")
    s.add_argument("--show-secrets", action="store_true")
    s.add_argument("--fail-on-findings", action="store_true")
    sub.add_parser("capabilities")
    sub.add_parser("rules-audit")
    for name in ("benchmark", "ablate"):
        b = sub.add_parser(name)
        b.add_argument("manifest")
        b.add_argument("--profile", choices=sorted(PROFILES), default="full")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodeseek").getOrCreate()
    config = load(args.config)
    rules = ordered(CORE_RULES, load_snapshot(args.rules) if args.rules else [])
    code = 0
    if args.command == "capabilities":
        out = [r.asDict() for r in capabilities(spark).collect()]
    elif args.command == "rules-audit":
        out = audit(spark, rules)
    elif args.command == "scan":
        if args.show_secrets:
            config = config.merged({"detection": {"show_secrets": True}})
        objects, large = files(spark, args.target, config.limits)
        records, _, warnings = localize(objects, config.limits)
        s = scan(records, rules, config, args.profile)
        s.warnings = s.warnings.unionByName(warnings).unionByName(large)
        out = report(s, args.target, config, rules)
        code = int(args.fail_on_findings and out["summary"]["findings"] > 0)
    else:
        artifacts, truth = evaluate.manifest(spark, args.manifest)
        root = artifacts.select("root").first()["root"]
        objects, _ = files(spark, root, config.limits)
        if (bad := evaluate.changed(artifacts, objects).head()) is not None:
            raise ValueError(f"artifact hash mismatch: {bad['artifact_id']}")
        records, _, _ = localize(objects, config.limits)
        out = []
        for profile in PROFILES if args.command == "ablate" else [args.profile]:
            found = scan(records, rules, config, profile).findings
            place = artifacts.select("artifact_id", "project_id", F.concat_ws("/", "root", "relative_path").alias("path"))
            got = found.join(place, found.root_path.endswith(place.path)).select("project_id", "artifact_id", "fingerprint", F.concat_ws(":", "nested_path", "location").alias("location"))
            out += [{"profile": profile} | r.asDict() for r in evaluate.scored(truth, got).collect()]
    text = json.dumps(out, indent=2, sort_keys=True, default=str)
    if getattr(args, "output", "-") == "-":
        print(text)
    else:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
