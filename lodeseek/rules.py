"""Credential rules: the core set, snapshots in the public TOML rule format, translation, audit."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORE, SNAPSHOT = "core", "snapshot"
CRC_BASE62 = "github-crc32-base62-six"


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    pattern: str
    min_length: int = 1
    max_length: int = 65536
    prefixes: tuple[str, ...] = ()
    charset: str | None = None
    delimiter_pattern: str | None = None
    checksum: str | None = None
    format_version: str | None = None
    secret_group: int = 0
    base_score: float = 0.5
    require_positive_context: bool = False
    entropy: float | None = None
    keywords: tuple[str, ...] = ()
    literals: tuple[str, ...] = ()  # a match holds one of these; for the native prefilter only
    allow_regexes: tuple[tuple[str, str], ...] = ()  # (target, pattern)
    allow_paths: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()
    provider: str = CORE
    priority: int = 100


# --- fixed values: formats of the core credential rules ---
CORE_RULES = (
    Rule("aws_access_key_id", "AWS Access Key ID", r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])", 20, 20, ("AKIA", "ASIA"), base_score=0.62, literals=("AKIA", "ASIA")),
    Rule("github_token", "GitHub Token", r"(?<![A-Za-z0-9])(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,255}(?![A-Za-z0-9])", 40, 260, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), checksum=CRC_BASE62, format_version="checksum-v1", base_score=0.66, literals=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("github_fine_grained_pat", "GitHub Fine-grained PAT", r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{40,255}(?![A-Za-z0-9])", 51, 266, ("github_pat_",), checksum=CRC_BASE62, format_version="checksum-v1", base_score=0.66, literals=("github_pat_",)),
    Rule("gitlab_pat", "GitLab Personal Access Token", r"(?<![A-Za-z0-9-])glpat-[A-Za-z0-9_-]{20,255}(?![A-Za-z0-9_-])", 26, 261, ("glpat-",), base_score=0.66, literals=("glpat-",)),
    Rule("slack_token", "Slack Token", r"(?<![A-Za-z0-9-])xox[baprs]-[A-Za-z0-9-]{10,255}(?![A-Za-z0-9-])", 15, 261, ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), base_score=0.66, literals=("xox",)),
    Rule("stripe_live_key", "Stripe Live Secret Key", r"(?<![A-Za-z0-9_])sk_live_[A-Za-z0-9]{16,255}(?![A-Za-z0-9])", 24, 263, ("sk_live_",), base_score=0.68, literals=("sk_live_",)),
    Rule("google_api_key", "Google API Key", r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", 39, 39, ("AIza",), base_score=0.64, literals=("AIza",)),
    Rule("pem_private_key", "PEM Private Key", r"(?s)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", 80, 65536, ("-----BEGIN",), base_score=0.75, literals=("-----BEGIN ",)),
    Rule("generic_assignment", "Generic Sensitive Assignment", r"""(?i)(?:api[_-]?key|access[_-]?token|auth[_-]?token|secret[_-]?key|password)\s*[:=]\s*["']?([A-Za-z0-9_./+\-=]{12,512})""", 12, 512, secret_group=1, base_score=0.45, require_positive_context=True, literals=(":", "=")),
)
SNAPSHOT_BASE_SCORE, SNAPSHOT_PRIORITY = 0.58, 50
CHECKED_SNAPSHOT_PREFIX = "github-"  # snapshot rules whose values carry the CRC-32 suffix
# --- end of fixed values ---


def to_regex(pattern: str) -> str:
    """For the ``regex`` engine."""
    return pattern.replace(r"\z", r"\Z")


_POSIX = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "space": r"\s", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "xdigit": r"\p{XDigit}", "punct": r"\p{Punct}"}


def to_java(pattern: str) -> str:
    """For Java: named groups, POSIX classes, bare braces, Unicode classes and case folding, only newline as line end."""
    out = re.sub(r"\(\?P<([A-Za-z][A-Za-z0-9]*)[^>]*>", r"(?<\1>", pattern)
    out = re.sub(r"\[:(\w+):\]", lambda m: _POSIX.get(m[1], m[0]), out)
    out = re.sub(r"(?<!\\)\{(?!\d+(?:,\d*)?\})(?<!p\{)(?<!P\{)", r"\\{", out) if re.search(r"(?<![\\pP])\{(?!\d)", out) else out
    out = re.sub(r"\(\?(-?[a-z]*)i", r"(?\1iu", out)
    unicode = "U" if re.search(r"\\[wWdDsSbB]", pattern) else ""
    return f"(?d{unicode}){out}"


def load_snapshot(path: str, provider: str = SNAPSHOT) -> list[Rule]:
    """Rules of a TOML file with ``[[rules]]`` (id, description, regex, keywords, entropy, secretGroup, allowlists) and a global ``[allowlist]``.

    Allow-lists are alternatives throughout, and the global one applies to every rule. Rules without a pattern are left out;
    rules for GitHub tokens are checked by their CRC-32 suffix.
    """
    with open(path, "rb") as f:
        data = tomllib.load(f)
    shared = data.get("allowlists") or ([data["allowlist"]] if data.get("allowlist") else [])
    out = []
    for r in data.get("rules", []):
        if not r.get("regex"):
            continue
        own = r.get("allowlists") or ([r["allowlist"]] if r.get("allowlist") else [])
        lists = [*shared, *own]
        checked = r["id"].startswith(CHECKED_SNAPSHOT_PREFIX)
        out.append(
            Rule(
                r["id"], r.get("description", r["id"]), r["regex"], secret_group=int(r.get("secretGroup", 0)), base_score=SNAPSHOT_BASE_SCORE, entropy=r.get("entropy"),
                keywords=tuple(r.get("keywords", ())), allow_regexes=tuple((a.get("regexTarget", "secret"), p) for a in lists for p in a.get("regexes", ())),
                allow_paths=tuple(p for a in lists for p in a.get("paths", ())), stopwords=tuple(dict.fromkeys([*r.get("stopwords", ()), *(s for a in lists for s in a.get("stopwords", ()))])),
                checksum=CRC_BASE62 if checked else None, format_version="checksum-v1" if checked else None, provider=provider, priority=SNAPSHOT_PRIORITY,
            )
        )
    return out


def ordered(*sources: tuple[Rule, ...] | list[Rule]) -> list[Rule]:
    return sorted((r for s in sources for r in s), key=lambda r: (-r.priority, r.id))


RULE_SCHEMA = "seq int, rule_id string, name string, pattern string, min_length int, max_length int, prefixes array<string>, charset string, delimiter_pattern string, checksum string, format_version string, secret_group int, base_score double, require_positive_context boolean, entropy double, provider string, priority int, pattern_sha256 string"


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row for each rule, in rule order."""
    return spark.createDataFrame(
        [
            (k, r.id, r.name, r.pattern, r.min_length, r.max_length, list(r.prefixes), r.charset, r.delimiter_pattern, r.checksum, r.format_version, r.secret_group, r.base_score, r.require_positive_context, r.entropy, r.provider, r.priority, hashlib.sha256(r.pattern.encode()).hexdigest())
            for k, r in enumerate(rules)
        ],
        RULE_SCHEMA,
    )


def compile_errors(rules: list[Rule]) -> list[dict[str, str]]:
    import regex

    out = []
    for r in rules:
        try:
            regex.compile(to_regex(r.pattern))
        except regex.error as e:
            out.append({"rule_id": r.id, "error": str(e)})
    return out


def conflicts(rules: DataFrame) -> DataFrame:
    """Patterns that several providers have."""
    return rules.groupBy("pattern_sha256").agg(F.count_distinct("provider").alias("providers"), F.sort_array(F.collect_set("rule_id")).alias("rule_ids")).where("providers > 1")


def stable_hash(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def audit(spark: SparkSession, rules: list[Rule]) -> dict[str, object]:
    frame = rules_frame(spark, rules)
    return {
        "rules_by_provider": {r["provider"]: r["count"] for r in frame.groupBy("provider").count().collect()},
        "content_sha256": stable_hash([asdict(r) for r in rules]),
        "compile_errors": compile_errors(rules),
        "conflicts": [r.asDict() for r in conflicts(frame).collect()],
    }


@dataclass
class Registry:
    """Rule providers by name; a provider is a callable that returns rules."""

    providers: dict[str, object] = field(default_factory=lambda: {CORE: lambda: CORE_RULES})

    def add(self, name: str, provider) -> None:
        if name in self.providers:
            raise ValueError(f"duplicate rule provider: {name}")
        self.providers[name] = provider

    def load(self) -> list[Rule]:
        return ordered(*(p() for p in self.providers.values()))
