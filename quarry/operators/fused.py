"""Many rules in one plan: checks become one projection of their base table.

A base table is read once and joined once to each side table that any of the checks needs. Each check gives an array of findings, empty for a row that passes; the
arrays are laid end to end and unrolled. Lines of SQL are cut once a text, for all checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import COUNTED, FINDINGS, Catalog
from ..config import Config
from ..functions.text import lines, numbered, trimmed_lines
from ..registry import SIDES, Check, Part


def base(catalog: Catalog, name: str, needs: set[str]) -> DataFrame:
    """Kept models or sources with ``model_name`` and ``file_path`` of their findings, and the columns of the side tables in ``needs``.

    ``sql`` stands for a model's text, null where there is none, with its ``_lines``, numbered, and ``_trimmed``, those without blank ends of the text.
    """
    if name == "models":
        rows = catalog.code(all_models=True) if "sql" in needs else catalog.kept_models()
        rows = rows.withColumn("_name", F.col("name"))
        if "sql" in needs:
            rows = rows.withColumns({"_lines": numbered(lines(F.col("sql"))), "_trimmed": trimmed_lines(F.col("sql"))})
    else:
        rows = catalog.sources.withColumns({"_name": F.concat_ws(".", "source_name", "name"), "file_path": F.lit("")})
    for need in sorted(needs - {"sql"}):
        rows = rows.join(SIDES[need].build(catalog), list(SIDES[need].keys), "left")
    return rows


def _parts(rule_id: str, severity: str, check: Check, x: Column | None, texts: bool) -> Column:
    def made(part: Part | str | None) -> Column:
        if callable(part) and not isinstance(part, Column):
            return part(x)
        return part if isinstance(part, Column) else F.lit(part)

    source, table = check.probe(x) if check.probe else (None, None)
    if not texts:
        return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), made(source).cast("string").alias("source"), made(table).cast("string").alias("table"))
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), made(check.line).cast("int").alias("line_number"), made(check.message).alias("message"),
        made(check.suggestion).alias("suggestion"), made(source).cast("string").alias("source"), made(table).cast("string").alias("table"),
    )


def found(rule_id: str, severity: str, check: Check, texts: bool = True) -> Column:
    """The findings of a row: null or an array."""
    if check.each is None:
        return F.when(check.hit, F.array(_parts(rule_id, severity, check, None, texts)))
    return F.when(check.hit, F.transform(check.each, lambda x: _parts(rule_id, severity, check, x, texts)))


def findings(catalog: Catalog, checks: dict[str, Check], config: Config, texts: bool = True) -> list[DataFrame]:
    """Findings of ``checks`` by rule id, a plan for each base table; without ``texts`` they are what roll-ups count, and no line or message is made."""
    out = []
    for name in dict.fromkeys(c.base for c in checks.values()):
        own = {k: c for k, c in checks.items() if c.base == name}
        rows = base(catalog, name, {n for c in own.values() for n in c.needs})
        each = [found(k, config.severity(k), c, texts) for k, c in own.items()]
        # The outer form keeps the optimizer from evaluating the array once more for a filter below.
        rows = rows.select("project_id", F.col("_name").alias("model_name"), "file_path", F.inline_outer(F.flatten(F.array_compact(F.array(*each))))).filter("rule_id is not null")
        if any(c.probe for c in own.values()):
            known = catalog.sources.select("project_id", F.lower("source_name").alias("source"), F.lower("name").alias("table")).distinct()
            # A finding without a probe has nulls here and meets nothing.
            rows = rows.join(known, ["project_id", "source", "table"], "left_anti")
        out.append(rows.select(*(FINDINGS if texts else COUNTED)))
    return out
