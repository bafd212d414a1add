"""Which language models review, with which key, and what they are told. Nothing here calls one."""

from __future__ import annotations

import importlib
import os
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

#: Providers in the order in which a key is looked for, and the variable that holds the key by default.
KEYS = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "gemini": "GEMINI_API_KEY"}
PRIMARY = "anthropic"
#: Ids that an answer may use.
FOUND = {
    "ai.business_logic_in_staging": "a staging model filters, joins or aggregates by business rules",
    "ai.complex_model_should_split": "a model does several things that would be clearer as steps",
    "ai.misleading_description": "a description says other than what the SQL computes",
    "ai.hardcoded_values": "numbers, dates, states or schema names are written out",
    "ai.poor_cte_structure": "names of CTEs say nothing, or CTEs hide the logic",
    "ai.missing_column_context": "an involved column has no description",
    "ai.general": "anything else that matters",
}


@dataclass(frozen=True)
class Target:
    provider: str
    model: str
    base_url: str | None = None


def _own(ai: Mapping[str, Any], provider: str) -> Mapping[str, Any]:
    return ai.get(provider) or {}


def enabled_providers(ai: Mapping[str, Any]) -> list[str]:
    """Providers that are switched on by name, else the primary one."""
    return [p for p in KEYS if _own(ai, p).get("enabled")] or [ai.get("provider") or PRIMARY]


def targets(ai: Mapping[str, Any]) -> list[Target]:
    """Every model of every enabled provider; the plain ``model`` comes first of the primary provider's."""
    out = []
    for provider in enabled_providers(ai):
        models = list(_own(ai, provider).get("models") or [])
        if ai.get("model") and provider == (ai.get("provider") or PRIMARY) and ai["model"] not in models:
            models.insert(0, ai["model"])
        out += [Target(provider, model, _own(ai, provider).get("base_url")) for model in models]
    return out


def key_variable(ai: Mapping[str, Any], provider: str) -> str:
    return _own(ai, provider).get("api_key_env_var") or KEYS[provider]


def required_keys(ai: Mapping[str, Any], environ: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Keys of all enabled providers; an error names every variable that is missing."""
    wanted = {p: key_variable(ai, p) for p in enabled_providers(ai)}
    missing = [v for v in wanted.values() if not environ.get(v)]
    if missing:
        raise OSError(f"set {', '.join(missing)} for the providers that are enabled")
    return {p: environ[v] for p, v in wanted.items()}


def first_with_key(ai: Mapping[str, Any], environ: Mapping[str, str] = os.environ) -> str | None:
    """The configured provider if its key is set, else the first of KEYS whose key is."""
    first = ai.get("provider") or PRIMARY
    return next((p for p in [first, *(p for p in KEYS if p != first)] if environ.get(key_variable(ai, p))), None)


def system_prompt(more: str = "") -> str:
    """What a reviewer is told before each model's prompt, with a team's own instructions at the end."""
    lines = [
        "You review SQL models of a data transformation project and report what makes them hard to trust or to maintain.",
        'Answer with JSON only: {"violations": [...]}, each with rule_id, severity (error, warning or info), message, suggestion and line_number; an empty list if nothing is wrong.',
        "Rule ids:", *[f"- {k}: {v}" for k, v in FOUND.items()],
        "Use error for what is wrong or misleading, warning for what should be mended, info for what could be better. Quote the SQL you mean. Report nothing that is not there.",
    ]
    return "\n".join(lines) + (f"\n\nOf this team:\n{more.strip()}\n" if more and more.strip() else "\n")


@dataclass(frozen=True)
class Named:
    """A provider that executors find by name, ``module:function``; the function gets what the reviewer is told and the model's prompt."""

    path: str
    told: str = ""

    def __call__(self, prompt: str):
        module, _, name = self.path.partition(":")
        return getattr(importlib.import_module(module), name)(self.told, prompt)


def reviewer(ai: Mapping[str, Any], path: str, environ: Mapping[str, str] = os.environ) -> Named:
    """The provider of a scan: keys of all enabled providers must be set."""
    required_keys(ai, environ)
    return Named(path, system_prompt(ai.get("additional_instructions", "")))
