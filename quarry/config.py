"""Configuration: which rules run, how severe they are, and their parameters."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

#: File names that are found without being named.
FILES = (".quarry.yml", ".quarry.yaml")
SEVERITIES = ("error", "warning", "info")
#: Weight of each category in the score; other categories are reported but not scored.
WEIGHTS = {
    "naming": 0.12,
    "structure": 0.20,
    "testing": 0.20,
    "documentation": 0.12,
    "materialization": 0.08,
    "style": 0.08,
    "migration": 0.12,
    "reuse": 0.08,
}


@dataclass
class Config:
    """``rules`` maps a full rule id to its settings; a rule without an entry is enabled with defaults."""

    severity_default: str = "warning"
    fail_on: str = "error"
    #: Report findings at changed files only, unless a scan says otherwise.
    changed_files_only: bool = False
    exclude_paths: list[str] = field(default_factory=lambda: ["dbt_packages/", "target/"])
    rules: dict[str, dict[str, Any]] = field(default_factory=dict)
    #: Behave like the tool whose files are read where this engine knows better: governance rules off, stars as derivations.
    compat_mode: bool = False
    ai: dict[str, Any] = field(default_factory=dict)
    custom_rules: list[dict[str, Any]] = field(default_factory=list)
    #: Name and description, for generated files; address of the metadata service.
    project: dict[str, Any] = field(default_factory=dict)
    service: dict[str, Any] = field(default_factory=dict)

    def enabled(self, rule_id: str) -> bool:
        if self.compat_mode and rule_id.startswith("governance."):
            return False
        return bool(self.rules.get(rule_id, {}).get("enabled", True))

    def severity(self, rule_id: str) -> str:
        found = self.rules.get(rule_id, {}).get("severity") or self.severity_default
        return found if found in SEVERITIES else "warning"

    def param(self, rule_id: str, name: str, default: Any) -> Any:
        own = self.rules.get(rule_id, {})
        return own.get(name, own.get("params", {}).get(name, default) if isinstance(own.get("params"), dict) else default)


def _declared(raw: dict[str, Any]) -> dict[str, Any]:
    """A declared rule under this engine's names, whichever of the two sets its author has used."""
    names = {"name": "id", "file_glob": "glob", "key_path": "key", "description": "message"}
    out = {names[k]: v for k, v in raw.items() if k in names} | {k: v for k, v in raw.items() if k not in names}
    if not out.get("id") or not (out.get("key") if out.get("type") == "yaml_key_exists" else out.get("pattern")):
        raise ValueError(f"a custom rule needs an id and a pattern, or a key if it is a yaml_key_exists: {raw}")
    return {k: v for k, v in out.items() if v is not None}


def from_dict(raw: dict[str, Any], known: set[str] | None = None) -> Config:
    """A config from a parsed YAML tree: categories of rules by short name. Unknown rules are warned of, not kept silent."""
    top = raw.get("global", {}) or {}
    out = Config(
        severity_default=top.get("severity_default", "warning"), fail_on=top.get("fail_on", "error"),
        changed_files_only=bool(top.get("changed_files_only", False)), exclude_paths=top.get("exclude_paths", ["dbt_packages/", "target/"]), compat_mode=bool(raw.get("compat_mode", False)),
        ai=raw.get("ai_review", raw.get("ai", {})) or {}, custom_rules=[_declared(x) for x in raw.get("custom_rules", []) or []],
        project=raw.get("project", {}) or {}, service=next((raw[k] for k in raw if k == "service" or k.endswith("_cloud")), {}) or {},
    )
    for category, body in raw.items():
        if not isinstance(body, dict) or category in ("global", "ai", "ai_review", "service", "project") or category.endswith("_cloud"):
            continue
        on = body.get("enabled", True)
        for name, settings in (body.get("rules") or {}).items():
            rule_id = name if "." in name else f"{category}.{name}"
            own = settings if isinstance(settings, dict) else {"enabled": bool(settings)}
            out.rules[rule_id] = {**own, "enabled": bool(on) and bool(own.get("enabled", True))}
            if known is not None and rule_id not in known:
                warnings.warn(f"unknown rule in the configuration: {rule_id}", stacklevel=2)
        if not on and known is not None:
            for rule_id in known:
                if rule_id.startswith(f"{category}."):
                    out.rules.setdefault(rule_id, {})["enabled"] = False
    return out


def load(path: str | None = None, root: str = ".", known: set[str] | None = None) -> Config:
    """Reads YAML; a path that is given must exist, else the first of FILES in ``root`` is used, else defaults."""
    import yaml

    if path is not None and not Path(path).exists():
        raise FileNotFoundError(path)
    found = Path(path) if path else next((Path(root) / f for f in FILES if (Path(root) / f).exists()), None)
    return from_dict(yaml.safe_load(found.read_text()) or {}, known) if found else Config()


def default_yaml(rules: list[tuple[str, str, str]]) -> str:
    """A commented template with every rule of ``rules`` (id, category, description)."""
    lines = ["# Rules and their severities. Remove a line to use the default.", "global:", "  severity_default: warning", "  fail_on: error", "  exclude_paths: [dbt_packages/, target/]"]
    for category in dict.fromkeys(c for _, c, _ in rules):
        lines += ["", f"{category}:", "  enabled: true", "  rules:"]
        for rule_id, own, text in rules:
            if own == category:
                lines += [f"    # {text}", f"    {rule_id.split('.', 1)[1]}: {{enabled: true, severity: warning}}"]
    return "\n".join(lines) + "\n"
