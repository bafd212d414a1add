"""Queries of reports and reviews over the star-schema catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Config
from ..operators import ai, custom, reuse_rules
from ..registry import RULES
from ..session import table
from ..sources import manifest, service, sinks, testdata

identical_selects = reuse_rules.identical_selects
NAMING = "naming.marts_prefix"


def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.sarif_results(RULES[NAMING].evaluate(testdata.catalog(spark, sf_dir), Config()))
    return rows.select("rule_id", "level", "located", F.get_json_object("result", "$.message.text").alias("text"), F.get_json_object("result", "$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"))


def github_annotation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.annotations(RULES[NAMING].evaluate(testdata.catalog(spark, sf_dir), Config()))
    return rows.groupBy(F.col("batch").cast("long").alias("batch"), "annotation_level").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.max("line").cast("long").alias("line"))


def ai_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ai.prompts(testdata.catalog(spark, sf_dir)).select("model_id", "prompt")


def ai_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    def strict(prompt: str) -> str:
        return '```json\n[{"severity": "grave", "message": "names a database"}]\n```' if "prod." in prompt else "no JSON"

    return ai.review(testdata.catalog(spark, sf_dir), strict).select("rule_id", "severity", "model_name", "message")


def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "conversations").select(F.col("role").alias("model"), F.length("text").alias("input_tokens"), (F.col("turn") + 1).alias("output_tokens"))
    prices = spark.createDataFrame([("user", 2.5, 10.0), ("assistant", 3.0, 15.0)], "model string, input double, output double")
    return ai.token_cost(usage, prices)


def custom_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = custom.custom_findings(testdata.catalog(spark, sf_dir), {"id": "no_union", "pattern": "(?i)union all", "glob": "models/marts/*", "severity": "error"})
    return rows.select("rule_id", "severity", "model_name", F.col("line_number").cast("long").alias("line_number"))


def _manifest(spark: SparkSession, sf_dir: str):
    return manifest.parse_manifests(testdata.manifest_text(spark, sf_dir))


def manifest_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of a manifest, as its JSON text says, with the files of every fourth laid over them."""
    own = _manifest(spark, sf_dir)
    files = own.models.filter(F.regexp_extract("name", "[0-9]+", 0).cast("long") % 4 == 0).select("project_id", F.col("file_path").alias("path"), F.concat(F.lit("select 1 -- "), "name").alias("content"))
    rows = manifest.overlay(own.models, files)
    return rows.select("project_id", "name", "file_path", "layer", "materialization", "description", F.md5(F.col("raw_code").cast("binary")).alias("code"))


def manifest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _manifest(spark, sf_dir)
    names = own.sources.select("source_id", F.concat_ws(".", "source_name", "name").alias("source"), "schema_name")
    return own.edges.join(names, F.col("parent_id") == F.col("source_id")).select("child_id", "source", "schema_name", "parent_kind")


def _parsed_rule(rule_id: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return RULES[rule_id].evaluate(_manifest(spark, sf_dir), Config()).select("model_name", "file_path", "message")

    return run


def environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environments of projects in their order: nations as environments of regions."""
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 6 > 0, F.col("n_name")).alias("name"), (F.col("n_regionkey") + F.when(F.col("n_nationkey") == 7, 90).otherwise(0)).alias("project_id"), F.when(F.col("n_nationkey") % 3 == 0, "development").otherwise("deployment").alias("type"), F.when(F.col("n_nationkey") % 4 == 1, "production").otherwise("").alias("deployment_type"))
    rows = service.listed_environments(own, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    return rows.select(F.col("id").cast("long").alias("id"), "name", "project_name", "type", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("type") == "development", "project_name", "name")).cast("long").alias("rank"))  # a row an environment


QUERIES = {f.__name__: f for f in (manifest_models, manifest_edges, environments, sarif_results, github_annotation_batches, ai_prompts, ai_review, token_cost, custom_rule)} | {f"parsed_{r.split('.')[1]}": _parsed_rule(r) for r in ("reuse.shared_cte_candidates", "reuse.duplicate_column_derivations", "reuse.identical_select_columns")}

_HEAD = testdata.duckdb_ctes()
_MARTS = "SELECT * FROM models WHERE layer = 'marts' AND left(name, 4) NOT IN ('fct_', 'dim_')"
_SUPPLIED = "WITH m AS (" + testdata.SUPPLIED.format(supplier="supplier", nation="nation") + ")"
_SHARED = "'Equivalent CTE logic appears in ' || n || ' models; here as ''' || cte || ''' in ''' || name || ''''"
SQL = {
    "manifest_models": f"{_SUPPLIED} SELECT 'geo' AS project_id, name, file_path, 'intermediate' AS layer, CASE WHEN k % 5 = 0 THEN 'table' ELSE 'view' END AS materialization, 'model ' || k AS description, md5(CASE WHEN k % 4 = 0 THEN 'select 1 -- ' || name ELSE sql END) AS code FROM m",
    "manifest_edges": f"{_SUPPLIED} SELECT 'model.geo.' || name AS child_id, 'geo.r' || region AS source, 'raw' AS schema_name, 'source' AS parent_kind FROM m",
    "parsed_shared_cte_candidates": f"{_SUPPLIED}, c AS (SELECT name, file_path, 'base' AS cte, count(*) OVER (PARTITION BY region, k % 3) AS n FROM m UNION ALL SELECT name, file_path, 'tidy', count(*) OVER () FROM m) SELECT name AS model_name, file_path, {_SHARED} AS message FROM c WHERE n >= 3",
    "parsed_duplicate_column_derivations": f"{_SUPPLIED}, d AS (SELECT name, file_path, 'name_upper' AS alias, 'upper(s_name)' AS expression, count(*) OVER () AS n FROM m UNION ALL SELECT name, file_path, 'scaled', 'balance * ' || (k % 4), count(*) OVER (PARTITION BY k % 4) FROM m) SELECT name AS model_name, file_path, 'Derived column ''' || alias || ''' is computed alike in ' || n || ' models: ' || expression AS message FROM d WHERE n >= 3",
    "parsed_identical_select_columns": f"{_SUPPLIED} SELECT name AS model_name, file_path, 'Model ''' || name || ''' selects the same 5 columns from the same inputs as ' || (n - 1) || ' others' AS message FROM (SELECT *, count(*) OVER (PARTITION BY region) AS n FROM m) q WHERE n > 1",
    "environments": "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 6 > 0 THEN n_name ELSE 'Environment ' || n_nationkey END AS name, p AS project_name, t AS type, row_number() OVER (ORDER BY t = 'development', p, CASE WHEN n_nationkey % 6 > 0 THEN n_name ELSE 'Environment ' || n_nationkey END) AS rank FROM (SELECT n.*, coalesce(r_name, 'Project ' || (n_regionkey + CASE WHEN n_nationkey = 7 THEN 90 ELSE 0 END)) AS p, CASE WHEN n_nationkey % 4 = 1 THEN 'production' WHEN n_nationkey % 3 = 0 THEN 'development' ELSE 'deployment' END AS t FROM nation n LEFT JOIN region ON r_regionkey = n_regionkey + CASE WHEN n_nationkey = 7 THEN 90 ELSE 0 END) q",
    "sarif_results": f"{_HEAD} SELECT 'naming.marts_prefix' AS rule_id, 'warning' AS level, true AS located, 'Marts model ''' || name || ''' starts with neither fct_ nor dim_' AS text, file_path AS uri FROM ({_MARTS}) m",
    "github_annotation_batches": f"{_HEAD} SELECT CAST((r - 1) // 50 AS BIGINT) AS batch, 'warning' AS annotation_level, count(*) AS n, min(file_path) AS first_path, CAST(1 AS BIGINT) AS line FROM (SELECT file_path, row_number() OVER (ORDER BY file_path, name) AS r FROM ({_MARTS}) m) q GROUP BY 1",
    "ai_prompts": f"""{_HEAD} SELECT m.model_id, 'Model: ' || name || chr(10) || 'Layer: ' || layer || chr(10) || 'Path: ' || file_path || coalesce(chr(10) || 'Columns: ' || array_to_string(list_slice(c.cols, 1, 30), ', '), '') || coalesce(chr(10) || 'Descriptions:' || chr(10) || array_to_string(list_slice(d.descs, 1, 15), chr(10)), '') || coalesce(chr(10) || 'Tests: ' || array_to_string(list_slice(t.names, 1, 10), ', '), '') || chr(10) || 'SQL:' || chr(10) || left(raw_code, 6000) AS prompt
 FROM models m LEFT JOIN (SELECT model_id, list(name ORDER BY pos) AS cols FROM columns GROUP BY 1) c ON c.model_id = m.model_id LEFT JOIN (SELECT model_id, list(name || ': ' || description ORDER BY pos) AS descs FROM columns WHERE trim(description) <> '' GROUP BY 1) d ON d.model_id = m.model_id LEFT JOIN (SELECT model_id, list(name ORDER BY name) AS names FROM tests GROUP BY 1) t ON t.model_id = m.model_id WHERE raw_code <> ''""",
    "ai_review": f"{_HEAD} SELECT 'ai.general' AS rule_id, 'warning' AS severity, name AS model_name, 'names a database' AS message FROM models WHERE contains(raw_code, 'prod.')",
    "token_cost": "SELECT role AS model, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS input_tokens, CAST(sum(turn + 1) AS BIGINT) AS output_tokens, round(coalesce((sum(length(text)) * CASE role WHEN 'user' THEN 2.5e0 WHEN 'assistant' THEN 3.0e0 END + sum(turn + 1) * CASE role WHEN 'user' THEN 10e0 WHEN 'assistant' THEN 15e0 END) / 1e6, 0), 6) AS cost FROM conversations GROUP BY 1",
    "custom_rule": f"{_HEAD} SELECT 'custom.no_union' AS rule_id, 'error' AS severity, name AS model_name, CAST(2 AS BIGINT) AS line_number FROM models WHERE starts_with(file_path, 'models/marts/') AND regexp_matches(raw_code, '(?i)union all')",
}
