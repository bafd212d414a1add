"""Files for reviewers and assistants, made from a configuration: a review checklist, a project's context, and a short form of both."""

from __future__ import annotations

from ..config import Config
from ..registry import RULES

#: Characters that readers of the short form take in, and where it is cut to leave room for a note.
LONGEST, CUT = 4000, 3900
TITLES = {"error": "Must be mended", "warning": "Should be mended", "info": "Worth a look"}


def by_severity(config: Config) -> dict[str, list[str]]:
    """Descriptions of the enabled rules, and of custom ones, by severity."""
    out: dict[str, list[str]] = {s: [] for s in TITLES}
    for r in RULES.values():
        if config.enabled(r.rule_id):
            out[config.severity(r.rule_id)].append(f"{config.rules.get(r.rule_id, {}).get('description') or r.description} (`{r.rule_id}`)")
    for c in config.custom_rules:
        out[c.get("severity") if c.get("severity") in out else "warning"].append(f"{c.get('description') or c.get('message') or c.get('id', '')} (`custom.{c.get('id', '')}`)")
    return out


def _title(config: Config) -> str:
    return config.project.get("name") or "Project"


def _checks(config: Config) -> list[str]:
    lines = []
    for severity, rules in by_severity(config).items():
        if rules:
            lines += [f"## {TITLES[severity]} ({severity})", "", *[f"- {r}" for r in rules], ""]
    return lines


def _scope(config: Config) -> list[str]:
    return ["## Scope", "", f"- Not reviewed: {', '.join(config.exclude_paths) or 'nothing is left out'}", f"- CI fails on `{config.fail_on}` severity or higher.", ""]


def review(config: Config) -> str:
    about = [config.project["description"].strip(), ""] if config.project.get("description") else []
    return "\n".join([f"# Review checklist: {_title(config)}", "", *about, *_checks(config), *_scope(config)])


def project(config: Config) -> str:
    """What someone new to the project, or an assistant, should know before changing a model."""
    about = [config.project["description"].strip(), ""] if config.project.get("description") else []
    place = config.service.get("environment_id")
    layers = ["## Layers", "", "- Models go from staging to intermediate to marts, a layer at a time.", "- Staging: stg_{source}__{entity}", "- Intermediate: int_{entity}_{verb}", "- Marts: fct_{entity}, dim_{entity}", ""]
    where = ["## Metadata", "", f"- Deployed environment `{place}`" + (f", account `{config.service['account_id']}`" if config.service.get("account_id") else ""), ""] if config.service.get("enabled") and place else []
    return "\n".join([f"# Project: {_title(config)}", "", *about, *layers, *where, *_checks(config), *_scope(config)])


def short(config: Config) -> str:
    """The checklist within LONGEST characters, for readers that take in no more."""
    whole = "\n".join([f"# {_title(config)}: how changes are reviewed", "", "Errors block a change; warnings are comments.", "", *_checks(config), *_scope(config)])
    return whole if len(whole) <= LONGEST else whole[:CUT].rsplit("\n", 1)[0] + "\n\n(Cut to 4,000 characters; the review checklist has all.)\n"


def terminal(config: Config) -> str:
    """For assistants that work in a terminal: the project, and how to check a change before it is handed over."""
    how = ["", "## Before a change is handed over", "", "- Run `python -m quarry.cli scan --changed-only` and mend its errors; say which warnings stay, and why.", "- Do not switch a rule off to pass.", ""]
    return project(config) + "\n".join(how)
