"""Project manifests, SQL and YAML files, and metadata pages as catalogs.

Any number of projects at once: paths are globs, and ``project_id`` is the project's name in the manifest, else the file's directory.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, infer_layer

_COLUMNS = "MAP<STRING, STRUCT<name: STRING, description: STRING, data_type: STRING>>"
SCHEMA = f"""STRUCT<
 metadata: STRUCT<project_name: STRING>,
 nodes: MAP<STRING, STRUCT<unique_id: STRING, name: STRING, resource_type: STRING, original_file_path: STRING, path: STRING, schema: STRING, database: STRING, description: STRING,
  raw_code: STRING, raw_sql: STRING, compiled_code: STRING, access: STRING, `group`: STRING, columns: {_COLUMNS}, config: MAP<STRING, STRING>, depends_on: STRUCT<nodes: ARRAY<STRING>>,
  tags: ARRAY<STRING>, meta: MAP<STRING, STRING>, test_metadata: STRUCT<name: STRING>, column_name: STRING>>,
 sources: MAP<STRING, STRUCT<unique_id: STRING, name: STRING, source_name: STRING, description: STRING, schema: STRING, database: STRING, loaded_at_field: STRING, tags: ARRAY<STRING>, meta: MAP<STRING, STRING>>>,
 exposures: MAP<STRING, STRUCT<unique_id: STRING, name: STRING, depends_on: STRUCT<nodes: ARRAY<STRING>>>>,
 metrics: MAP<STRING, STRUCT<unique_id: STRING, name: STRING, depends_on: STRUCT<nodes: ARRAY<STRING>>>>>"""


def _entries(raw: DataFrame, field: str) -> DataFrame:
    """One row an entry of a map, in the order of the file."""
    return raw.select("project_id", F.posexplode(F.map_entries(f"m.{field}")).alias("idx", "e")).select("project_id", F.col("idx").cast("long").alias("idx"), F.col("e.key").alias("id"), F.col("e.value").alias("v"))


def parse_manifests(raw: DataFrame, text: str = "value") -> Catalog:
    """``raw``: one manifest a row, as JSON text, with the ``path`` that it came from."""
    parsed = raw.select(F.from_json(text, F.lit(SCHEMA)).alias("m"), "path").withColumn("project_id", F.coalesce("m.metadata.project_name", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))
    nodes = _entries(parsed, "nodes")
    kind = lambda c, k: F.startswith(c, F.lit(k + "."))
    own = nodes.filter("v.resource_type = 'model'")
    code = F.coalesce(F.nullif("v.raw_code", F.lit("")), "v.raw_sql", F.lit(""))
    path = F.coalesce("v.original_file_path", "v.path", F.lit(""))
    contract = F.get_json_object(F.col("v.config")["contract"], "$.enforced") == "true"
    models = own.select(
        "project_id", F.col("id").alias("model_id"), "idx", F.col("v.name").alias("name"), path.alias("file_path"), F.coalesce(F.col("v.config")["materialized"], F.lit("")).alias("materialization"), F.coalesce("v.description", F.lit("")).alias("description"),
        infer_layer(path, F.col("v.name")).alias("layer"), F.coalesce(contract, F.lit(False)).alias("contract_enforced"), F.col("v.access").alias("access"), F.col("v.group").alias("grp"), F.coalesce("v.tags", F.array().cast("array<string>")).alias("tags"),
        "v.meta", "v.config", code.alias("raw_code"), F.col("v.compiled_code").alias("compiled_code"))
    columns = own.select("project_id", F.col("id").alias("model_id"), F.posexplode(F.map_entries("v.columns")).alias("pos", "c")).select("project_id", "model_id", F.col("pos").cast("long").alias("pos"), F.coalesce("c.value.name", "c.key").alias("name"), F.coalesce("c.value.description", F.lit("")).alias("description"), "c.value.data_type")
    tests = nodes.filter("v.resource_type = 'test'").select("project_id", F.explode("v.depends_on.nodes").alias("model_id"), F.col("id").alias("test_id"), F.col("v.name").alias("name"), F.col("v.column_name").alias("column_name"), F.col("v.test_metadata.name").alias("test_type"))
    # Parents: models first, then sources, each in the order of the file; other kinds are no part of the lineage.
    parents = own.select("project_id", F.col("id").alias("child_id"), F.posexplode("v.depends_on.nodes").alias("at", "parent_id")).filter(kind(F.col("parent_id"), "model") | kind(F.col("parent_id"), "source"))
    source = kind(F.col("parent_id"), "source")
    edges = parents.select("project_id", "child_id", "parent_id", (F.col("at") + F.when(source, 1 << 30).otherwise(0)).cast("long").alias("pos"), F.when(source, "source").otherwise("model").alias("parent_kind"))
    sources = _entries(parsed, "sources").select(
        "project_id", F.col("id").alias("source_id"), "idx", F.coalesce("v.source_name", F.lit("")).alias("source_name"), F.coalesce("v.name", F.lit("")).alias("name"), F.coalesce("v.description", F.lit("")).alias("description"), F.coalesce("v.schema", F.lit("")).alias("schema_name"),
        F.col("v.database").alias("database"), F.col("v.loaded_at_field").alias("loaded_at_field"), F.lit(None).cast("string").alias("max_loaded_at"), F.coalesce("v.tags", F.array().cast("array<string>")).alias("tags"), "v.meta")
    used = lambda field, name: _entries(parsed, field).select("project_id", F.col("id").alias(name), F.col("v.name").alias("name"), F.explode_outer("v.depends_on.nodes").alias("parent_id"))
    return Catalog(models, columns, tests, sources, edges, used("exposures", "exposure_id"), metrics=used("metrics", "metric_id"))


def read_manifests(spark: SparkSession, path: str) -> Catalog:
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return parse_manifests(raw)


def read_files(spark: SparkSession, root: str, project_id: str, endings: tuple[str, ...] = (".sql",)) -> DataFrame:
    """Files of a project under models/ with paths relative to ``root``.

    A checkout is on the driver's disk, which executors don't see, and Spark's readers pass over names like _models.yml, so it is read there, a few
    MB at most. Any other root is read by Spark.
    """
    schema = "project_id string, path string, content string"
    if Path(root).is_dir():
        files = sorted(f for f in (Path(root) / "models").rglob("*") if f.suffix in endings and f.is_file())
        return spark.createDataFrame([(project_id, f.relative_to(root).as_posix(), f.read_text(encoding="utf-8", errors="replace")) for f in files], schema)
    files = spark.read.text(f"{root.rstrip('/')}/models", wholetext=True, recursiveFileLookup=True, pathGlobFilter="*{" + ",".join(endings) + "}")
    path = F.concat(F.lit("models/"), F.regexp_extract(F.col("_metadata.file_path"), r"/models/(.*)$", 1))
    return files.select(F.lit(project_id).alias("project_id"), path.alias("path"), F.col("value").alias("content"))


def overlay(models: DataFrame, files: DataFrame) -> DataFrame:
    """``models`` with the code of the files at their paths where there are such files."""
    side = files.select("project_id", F.col("path").alias("file_path"), "content")
    code = F.coalesce(F.nullif("content", F.lit("")), "raw_code")
    return models.join(side, ["project_id", "file_path"], "left").withColumn("raw_code", code).drop("content")


def with_files(out: Catalog, spark: SparkSession, root: str, project: str) -> Catalog:
    """``out`` with the SQL and YAML files of a checkout, if there is one; SQL files take the place of stored code."""
    if (Path(root) / "models").is_dir():
        out.sql_files = read_files(spark, root, project)
        out.yaml_files = read_files(spark, root, project, (".yml", ".yaml")).filter(F.col("content").rlike(r"(?m)^(?!\s*(?:#|---\s*$))\s*\S")).select("project_id", "path", "content")
        out.models = overlay(out.models, out.sql_files)
    return out


def read_project(spark: SparkSession, root: str, manifest: str) -> Catalog:
    """A checked-out project: its manifest, with SQL and YAML files from disk."""
    out = read_manifests(spark, manifest)
    name = out.models.select("project_id").first()
    return with_files(out, spark, root, name[0] if name else "")


#: Variables in which a build says what a change is to be merged into; the first is this engine's own.
BASE_VARIABLES = ["QUARRY_BASE_REF", "GITHUB_BASE_REF", "CI_MERGE_REQUEST_TARGET_BRANCH_NAME"]


def base_refs(environ: Mapping[str, str] = os.environ) -> list[str]:
    """Revisions to compare with, likeliest first: branches named by the build, of the remote unless they say otherwise, and the main branches."""
    named = [environ[v] for v in BASE_VARIABLES if environ.get(v)]
    return [*(b if "/" in b else f"origin/{b}" for b in named), "origin/main", "origin/master"]


def project_settings(root: str) -> dict:
    """The project's own YAML file, or {} without one. No rule reads it."""
    import yaml

    found = sorted(Path(root).glob("*_project.yml"))
    return (yaml.safe_load(found[0].read_text(encoding="utf-8")) or {}) if found else {}


def changed_files(spark: SparkSession, root: str, project_id: str, base: str | None = None) -> DataFrame:
    """Paths that differ from a base revision: the given one, else those of base_refs, else the last commit."""
    for ref in [base] if base else [*base_refs(), "HEAD~1"]:
        done = subprocess.run(["git", "-C", root, "diff", "--name-only", "--diff-filter=ACMR", f"{ref}...HEAD"], capture_output=True, text=True)
        if done.returncode == 0:
            break
    paths = [(project_id, x) for x in done.stdout.splitlines() if x] if done.returncode == 0 else []
    return spark.createDataFrame(paths, "project_id string, path string")


PAGE = """STRUCT<environment: STRUCT<applied: STRUCT<
 models: STRUCT<edges: ARRAY<STRUCT<node: STRUCT<uniqueId: STRING, name: STRING, filePath: STRING, description: STRING, materializedType: STRING, contractEnforced: BOOLEAN, access: STRING, `group`: STRING, tags: ARRAY<STRING>, meta: MAP<STRING, STRING>, rawCode: STRING, compiledCode: STRING,
  tests: ARRAY<STRUCT<name: STRING, columnName: STRING>>, catalog: STRUCT<columns: ARRAY<STRUCT<name: STRING, description: STRING, type: STRING>>>>>>>,
 sources: STRUCT<edges: ARRAY<STRUCT<node: STRUCT<uniqueId: STRING, name: STRING, sourceName: STRING, description: STRING, schema: STRING, database: STRING, loadedAtField: STRING, tags: ARRAY<STRING>, meta: MAP<STRING, STRING>, freshness: STRUCT<maxLoadedAt: STRING>>>>>,
 exposures: STRUCT<edges: ARRAY<STRUCT<node: STRUCT<uniqueId: STRING, name: STRING, parents: ARRAY<STRUCT<uniqueId: STRING>>>>>>,
 lineage: ARRAY<STRUCT<uniqueId: STRING, parentIds: ARRAY<STRING>>>>>>"""


def parse_pages(raw: DataFrame, project_id: str | Column, text: str = "value") -> Catalog:
    """A catalog from stored pages of a metadata service, one JSON page a row; ``project_id`` may be a column of ``raw``. Config is never part of a page.

    Dependencies are the direct parents that the lineage gives, not ancestors.
    """
    own_project = project_id if isinstance(project_id, Column) else F.lit(project_id)
    pages = raw.select(own_project.alias("project_id"), F.monotonically_increasing_id().alias("page"), F.from_json(text, F.lit(PAGE))["environment"]["applied"].alias("p"))
    project = F.col("project_id")

    def nodes(field: str) -> DataFrame:
        return pages.select("project_id", "page", F.posexplode(f"p.{field}.edges").alias("at", "e")).select("project_id", (F.col("page") * 100_000 + F.col("at")).alias("idx"), F.col("e.node").alias("v"))

    own = nodes("models")
    path = F.coalesce("v.filePath", F.lit(""))
    none: Column = F.lit(None).cast("map<string,string>")
    models = own.select(
        project, F.col("v.uniqueId").alias("model_id"), "idx", F.col("v.name").alias("name"), path.alias("file_path"), F.coalesce("v.materializedType", F.lit("")).alias("materialization"), F.coalesce("v.description", F.lit("")).alias("description"), infer_layer(path, F.col("v.name")).alias("layer"),
        F.coalesce("v.contractEnforced", F.lit(False)).alias("contract_enforced"), F.col("v.access").alias("access"), F.col("v.group").alias("grp"), F.coalesce("v.tags", F.array().cast("array<string>")).alias("tags"), "v.meta", none.alias("config"), F.coalesce("v.rawCode", F.lit("")).alias("raw_code"), F.col("v.compiledCode").alias("compiled_code"))
    columns = own.select(project, F.col("v.uniqueId").alias("model_id"), F.posexplode("v.catalog.columns").alias("pos", "c")).select("project_id", "model_id", F.col("pos").cast("long").alias("pos"), "c.name", F.coalesce("c.description", F.lit("")).alias("description"), F.col("c.type").alias("data_type"))
    tests = own.select(project, F.col("v.uniqueId").alias("model_id"), F.explode("v.tests").alias("t")).select("project_id", "model_id", F.concat(F.lit("test."), "t.name").alias("test_id"), "t.name", F.col("t.columnName").alias("column_name"), F.lit(None).cast("string").alias("test_type"))
    lineage = pages.select("project_id", F.explode("p.lineage").alias("l")).select("project_id", F.col("l.uniqueId").alias("child_id"), F.posexplode("l.parentIds").alias("pos", "parent_id")).dropDuplicates(["project_id", "child_id", "parent_id"])
    edges = lineage.filter("child_id like 'model.%' and (parent_id like 'model.%' or parent_id like 'source.%')").select(project, "child_id", "parent_id", F.col("pos").cast("long").alias("pos"), F.substring_index("parent_id", ".", 1).alias("parent_kind"))
    sources = nodes("sources").select(
        project, F.col("v.uniqueId").alias("source_id"), "idx", F.col("v.sourceName").alias("source_name"), F.col("v.name").alias("name"), F.coalesce("v.description", F.lit("")).alias("description"), F.coalesce("v.schema", F.lit("")).alias("schema_name"), F.col("v.database").alias("database"),
        F.col("v.loadedAtField").alias("loaded_at_field"), F.col("v.freshness.maxLoadedAt").alias("max_loaded_at"), F.coalesce("v.tags", F.array().cast("array<string>")).alias("tags"), "v.meta")
    exposures = nodes("exposures").select(project, F.col("v.uniqueId").alias("exposure_id"), F.col("v.name").alias("name"), F.explode_outer("v.parents").alias("x")).select("project_id", "exposure_id", "name", F.col("x.uniqueId").alias("parent_id"))
    return Catalog(models, columns, tests, sources, edges, exposures)
