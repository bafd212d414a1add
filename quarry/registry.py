"""The register of rules: each is a function of a catalog and its settings that returns a check of rows, or a plan of its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import COUNTED, FINDINGS, Catalog
from .config import SEVERITIES, Config



class Settings:
    """Parameters of a rule by name, with a default; ``of`` gives those of another rule."""

    def __init__(self, config: Config, rule_id: str) -> None:
        self.config, self.rule_id = config, rule_id

    def __call__(self, name: str, default: Any) -> Any:
        return self.config.param(self.rule_id, name, default)

    def of(self, rule_id: str) -> Settings:
        return Settings(self.config, rule_id)



#: A column, or one made of an element of an array.
Part = Column | Callable[[Column], Column]


@dataclass(frozen=True)
class Check:
    """A rule as a test of each row of a base table, from which a plan of its own or one projection for many rules is made (see ``operators.fused``).

    ``hit`` tells the rows that fail. With ``each``, an array, every element is a finding and the other parts may be functions of it. ``needs`` names side tables
    (see ``side``); ``probe`` gives a source and a table, in lower case, that make a finding only if the project does not define them.
    """

    hit: Column
    message: Part
    suggestion: Part | str = ""
    base: str = "models"
    needs: tuple[str, ...] = ()
    line: Part | None = None
    each: Column | None = None
    probe: Callable[[Column], tuple[Column, Column]] | None = None


@dataclass(frozen=True)
class Side:
    """A table with at most a row for each row of a base table, joined to it on ``keys``."""

    base: str
    keys: tuple[str, ...]
    build: Callable[[Catalog], DataFrame]


SIDES: dict[str, Side] = {}


def side(name: str, base: str = "models", keys: tuple[str, ...] = ("project_id", "model_id")) -> Callable:
    def keep(build: Callable[[Catalog], DataFrame]) -> Callable:
        SIDES[name] = Side(base, keys, build)
        return build

    return keep


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    description: str
    default_severity: str
    build: Callable[[Catalog, Settings], Check | DataFrame]

    def evaluate(self, catalog: Catalog, config: Config) -> DataFrame:
        """Findings of this rule, with the severity that the configuration gives it."""
        return evaluate(catalog, config, [self])


def evaluate(catalog: Catalog, config: Config, rules: list[Rule], more: dict[str, Check | DataFrame] | None = None, texts: bool = True) -> DataFrame:
    """Findings of ``rules``, and of ``more`` by rule id: those that are checks share one projection of each base table, the others are plans of their own. Without ``texts`` they have no lines and messages."""
    from .operators import fused

    made = {r.rule_id: r.build(catalog, Settings(config, r.rule_id)) for r in rules} | (more or {})
    checks = {k: v for k, v in made.items() if isinstance(v, Check)}
    plans = fused.findings(catalog, checks, config, texts) if checks else []
    return reduce(DataFrame.unionByName, plans + [_plain(k, v, config).select(*(FINDINGS if texts else COUNTED)) for k, v in made.items() if k not in checks])


def _plain(rule_id: str, rows: DataFrame, config: Config) -> DataFrame:
    own = {"rule_id": F.lit(rule_id), "severity": F.lit(config.severity(rule_id))}
    if "line_number" not in rows.columns:
        own["line_number"] = F.lit(None).cast("int")
    if "suggestion" not in rows.columns:
        own["suggestion"] = F.lit(None).cast("string")
    return rows.withColumns(own).select(*FINDINGS)


RULES: dict[str, Rule] = {}


def rule(rule_id: str, description: str, severity: str = "warning") -> Callable:
    def keep(build: Callable[[Catalog, Settings], Check | DataFrame]) -> Callable:
        RULES[rule_id] = Rule(rule_id, rule_id.split(".")[0], description, severity, build)
        return build

    return keep


def rule_counts(config: Config) -> dict[str, dict[str, int]]:
    """Enabled rules by category and by severity."""
    on = [r for r in RULES.values() if config.enabled(r.rule_id)]
    severities = [config.severity(r.rule_id) for r in on]
    return {"categories": {c: sum(r.category == c for r in on) for c in dict.fromkeys(r.category for r in RULES.values())}, "severities": {s: severities.count(s) for s in SEVERITIES}}


def found(rows: DataFrame, message: Column, suggestion: str | Column = "", name: str = "name", path: str | Column = "file_path", line: str | None = None) -> DataFrame:
    """Findings of ``rows``, before severity."""
    made = [F.col("project_id"), F.col(name).alias("model_name"), (F.col(path) if isinstance(path, str) else path).alias("file_path"), message.alias("message"), (F.lit(suggestion) if isinstance(suggestion, str) else suggestion).alias("suggestion")]
    return rows.select(*made, *([F.col(line).cast("int").alias("line_number")] if line else []))


def say(pattern: str, *values: Any) -> Column:
    """A message: ``{}`` stands for each value in turn, a column's name or a column."""
    parts = pattern.split("{}")
    out: list[Column] = [F.lit(parts[0])]
    for value, text in zip(values, parts[1:], strict=True):
        out += [F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit("")), F.lit(text)]
    return F.concat(*out)
