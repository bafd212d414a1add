"""The relational catalog that all rules read, and the shape of what they find.

Every table carries ``project_id``, so one plan serves any number of projects. ``idx`` and ``pos`` keep the order of the
project file, which lists in messages follow.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import materialize

#: Columns of each table.
MODELS = (
    "project_id string, model_id string, idx bigint, name string, file_path string, materialization string, description string, "
    "layer string, contract_enforced boolean, access string, grp string, tags array<string>, meta map<string,string>, "
    "config map<string,string>, raw_code string, compiled_code string"
)
COLUMNS = "project_id string, model_id string, pos bigint, name string, description string, data_type string"
TESTS = "project_id string, model_id string, test_id string, name string, column_name string, test_type string"
SOURCES = (
    "project_id string, source_id string, idx bigint, source_name string, name string, description string, schema_name string, "
    "database string, loaded_at_field string, max_loaded_at string, tags array<string>, meta map<string,string>"
)
EDGES = "project_id string, child_id string, parent_id string, pos bigint, parent_kind string"
EXPOSURES = "project_id string, exposure_id string, name string, parent_id string"
METRICS = "project_id string, metric_id string, name string, parent_id string"
FILES = "project_id string, path string, content string"

FINDINGS = ["project_id", "rule_id", "severity", "model_name", "file_path", "line_number", "message", "suggestion"]
#: Those of them that roll-ups read.
COUNTED = FINDINGS[:5]


@dataclass
class Catalog:
    models: DataFrame
    columns: DataFrame
    tests: DataFrame
    sources: DataFrame
    edges: DataFrame
    exposures: DataFrame
    metrics: DataFrame | None = None
    sql_files: DataFrame | None = None
    yaml_files: DataFrame | None = None
    changed: DataFrame | None = None
    excluded: list[str] = field(default_factory=lambda: ["dbt_packages/", "target/"])

    def kept_models(self) -> DataFrame:
        """Models outside of the excluded paths."""
        return self.models.filter(~is_excluded(F.col("file_path"), self.excluded))

    def code(self, all_models: bool = False) -> DataFrame:
        """Kept models with ``sql``: their own code, else that of the file at their path; those without are left out, or have null."""
        rows = self.kept_models()
        own = F.nullif(F.col("raw_code"), F.lit(""))
        if self.sql_files is not None:
            files = self.sql_files.select("project_id", F.col("path").alias("file_path"), "content")
            rows = rows.join(files, ["project_id", "file_path"], "left")
            own = F.coalesce(own, F.nullif(F.col("content"), F.lit("")))
        rows = rows.withColumn("sql", own)
        return rows if all_models else rows.filter("sql is not null")

    def written(self, excluded: list[str] | None = None) -> Catalog:
        """A catalog of its own whose tables are written to the shared folder, so rules read them instead of making them again."""
        names = ("models", "edges", "tests", "columns", "sources", "exposures", "yaml_files", "sql_files", "changed")
        made = {n: materialize(getattr(self, n), n) for n in names if getattr(self, n) is not None}
        return replace(self, **made, excluded=self.excluded if excluded is None else excluded)


def is_excluded(path: Column, prefixes: list[str]) -> Column:
    tests = [path.startswith(x) | path.contains("/" + x) for x in prefixes]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def infer_layer(path: Column, name: Column) -> Column:
    """Layer of a model; the first that fits, so a fct_ model under /staging/ is staging."""
    p, n = F.lower(F.coalesce(path, F.lit(""))), F.lower(name)
    return (
        F.when(p.contains("/staging/") | n.startswith("stg_"), "staging")
        .when(p.contains("/intermediate/") | n.startswith("int_"), "intermediate")
        .when(p.contains("/marts/") | n.startswith("fct_") | n.startswith("dim_"), "marts")
        .otherwise("other")
    )


def truthy(value: Column) -> Column:
    """Whether a config value (JSON text of the value) counts as set."""
    return F.coalesce(~F.trim(value).isin("", "null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def blank(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit(""))) == ""
