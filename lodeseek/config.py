"""Configuration: limits, detection weights and context lists, merged from defaults, YAML and overrides."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from typing import Any

# --- fixed values: defaults of the scan ---
POSITIVE_CONTEXT = ("api_key", "apikey", "access_key", "secret_key", "access_token", "auth_token", "bearer", "credential", "password", "private_key")
NEGATIVE_CONTEXT = ("test", "tests", "fixture", "sample", "example", "tutorial", "documentation")
PLACEHOLDERS = ("your_key", "your_api_key", "example_token", "changeme", "replace_me", "dummy", "placeholder", "xxxxxxxxxx")
# --- end of fixed values ---


@dataclass(frozen=True)
class Limits:
    max_depth: int = 5
    max_object_size: int = 50 << 20
    max_expanded_size: int = 250 << 20
    max_archive_members: int = 5000
    max_compression_ratio: float = 200.0
    max_sqlite_rows: int = 10_000
    max_sqlite_vm_steps: int = 2_000_000
    max_decode_depth: int = 3
    max_decode_output: int = 1 << 20
    max_ocr_variants: int = 32
    max_recovery_beam: int = 64
    max_plan_operations: int = 16
    max_plan_output: int = 1 << 20
    max_rule_matches: int = 10_000


@dataclass(frozen=True)
class Detection:
    minimum_score: float = 0.65
    minimum_generic_entropy: float = 3.2
    carrier_weight: float = 0.08
    field_relation_weight: float = 0.10
    recovery_weight: float = 0.20
    positive_context_weight: float = 0.06
    negative_context_weight: float = 0.06
    max_regex_seconds: float = 0.25
    show_secrets: bool = False


@dataclass(frozen=True)
class Config:
    limits: Limits = field(default_factory=Limits)
    detection: Detection = field(default_factory=Detection)
    positive_context: tuple[str, ...] = POSITIVE_CONTEXT
    negative_context: tuple[str, ...] = NEGATIVE_CONTEXT
    placeholders: tuple[str, ...] = PLACEHOLDERS

    def merged(self, override: dict[str, Any]) -> Config:
        """A copy with a nested mapping laid over it; unknown keys are errors."""
        return _merged(self, override)

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


def _merged(base: Any, override: dict[str, Any]) -> Any:
    known = {f.name for f in fields(base)}
    if extra := set(override) - known:
        raise ValueError(f"unknown configuration keys: {', '.join(sorted(extra))}")
    new = {}
    for k, v in override.items():
        old = getattr(base, k)
        new[k] = _merged(old, v) if is_dataclass(old) else tuple(v) if isinstance(v, list) else v
    return replace(base, **new)


def load(path: str | None = None) -> Config:
    """Defaults, with a YAML file laid over them."""
    if path is None:
        return Config()
    import yaml

    with open(path, encoding="utf-8") as f:
        return Config().merged(yaml.safe_load(f) or {})
