"""A project catalog made of star-schema tables: nations, customers and orders are models in a lineage, regions and parts their sources.

The text below is SQL that Spark and DuckDB read alike, so the same catalog stands behind a query and its check.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, infer_layer
from ..session import table

_COLUMN = "CASE l_linenumber WHEN 1 THEN 'customer_email' WHEN 2 THEN 'amount' WHEN 3 THEN 'status' WHEN 4 THEN 'ip_addr_v4' WHEN 5 THEN 'phone' ELSE 'c' || l_linenumber END"
_CODE = """CASE k % 17
 WHEN 0 THEN 'with a as (' || chr(10) || 'select * from {{{{ ref(''int_x'') }}}}' || chr(10) || ')' || chr(10) || 'select * from a'
 WHEN 1 THEN 'select o.id, o.total' || chr(10) || 'from prod.orders o'
 WHEN 2 THEN '-- made by hand' || chr(10) || 'create table x as' || chr(10) || 'select 1 as one_column'
 WHEN 3 THEN 'select x.a, y.b' || chr(10) || 'from {{{{ ref(''a'') }}}} x' || chr(10) || 'join {{{{ ref(''b'') }}}} y on x.id = y.id'
 WHEN 4 THEN 'with l as (' || chr(10) || 'select 1 as c' || chr(10) || '),' || chr(10) || 'i as (' || chr(10) || 'select * from {{{{ source(''geo'', ''region_asia'') }}}}' || chr(10) || ')' || chr(10) || 'select c from l'
 WHEN 5 THEN '-- handle with care' || chr(10) || 'select *' || chr(10) || 'from {{{{ ref(''a'') }}}}' || chr(10)
 WHEN 6 THEN 'select x' || chr(10) || 'from db' || k || '.sch.tab'
 WHEN 7 THEN 'select x from {{{{ ref(''a'') }}}}' || chr(10) || 'where password = ''hunter' || k || ''' and api_key = ''0123456789'''
 WHEN 8 THEN 'select id from {{{{ source(''nowhere'', ''t' || k || ''') }}}}' || chr(10) || 'union all' || chr(10) || 'select id from {{{{ source(''geo'', ''region_asia'') }}}}'
 WHEN 9 THEN 'INSERT INTO t' || chr(10) || 'select 1 from {{{{ ref(''a'') }}}}'
 WHEN 10 THEN ''
 WHEN 12 THEN 'select x.id' || chr(13) || chr(10) || 'from prod.orders x' || chr(13) || chr(10) || 'join {{{{ ref(''a'') }}}} y on true' || chr(13) || chr(10)
 WHEN 13 THEN '{{# join {{{{ ref(''old'') }}}} #}}' || chr(10) || 'select "a"."b" from "raw"."orders" -- from db.sch.tab'
 WHEN 14 THEN 'truncate table t' || chr(10) || 'merge into x using y on x.id = y.id' || chr(10) || 'select * from {{{{source("nowhere","T")}}}}'
 WHEN 15 THEN 'select' || chr(160) || 'a' || chr(10) || 'from staging.t' || chr(10) || 'delete from t where api_key = "abcdefgh12"'
 WHEN 16 THEN 'WITH a AS (' || chr(10) || '  select 1' || chr(10) || ')' || chr(10) || '  SELECT *' || chr(10) || 'FROM a' || chr(10) || '  '
 ELSE 'select 1' END"""

#: Table: its SQL over the star schema, with {table} for each table that is read.
TABLES = {
    "base_models": f"""
SELECT 'p' AS project_id, 'model.n' || n_nationkey AS model_id, CAST(n_nationkey AS BIGINT) * 4 AS idx, CAST(n_nationkey AS BIGINT) AS k, 'n' AS kind,
 CASE WHEN n_nationkey % 5 = 0 THEN 'nation_' || n_nationkey ELSE 'stg_r' || n_regionkey || '__n' || n_nationkey END AS name,
 CASE WHEN n_nationkey % 6 = 0 THEN 'models/staging/x' || n_nationkey || '.sql' WHEN n_nationkey % 5 = 0 THEN 'models/staging/nation_' || n_nationkey || '.sql' ELSE 'models/staging/stg_r' || n_regionkey || '__n' || n_nationkey || '.sql' END AS file_path,
 CASE WHEN n_nationkey % 4 = 0 THEN 'table' ELSE 'view' END AS materialization, '' AS raw_code FROM {{nation}}
UNION ALL
SELECT 'p', 'model.c' || c_custkey, CAST(c_custkey AS BIGINT) * 4 + 1, CAST(c_custkey AS BIGINT), 'c',
 CASE WHEN c_custkey % 9 = 0 THEN 'cust' || c_custkey ELSE 'int_cust' || c_custkey END,
 CASE WHEN c_custkey % 11 = 0 THEN 'dbt_packages/x/intermediate/c' || c_custkey || '.sql' WHEN c_custkey % 9 = 0 THEN 'models/intermediate/g' || (c_custkey % 7) || '/cust' || c_custkey || '.sql' ELSE 'models/intermediate/g' || (c_custkey % 7) || '/int_cust' || c_custkey || '.sql' END,
 CASE WHEN c_custkey % 7 = 0 THEN 'incremental' WHEN c_custkey % 5 = 0 THEN 'table' ELSE 'view' END, '' FROM {{customer}}
UNION ALL
SELECT 'p', 'model.s' || s_suppkey, CAST(s_suppkey AS BIGINT) * 4 + 2, CAST(s_suppkey AS BIGINT), 's', 'supp' || s_suppkey, 'models/other/supp' || s_suppkey || '.sql', 'ephemeral', '' FROM {{supplier}}
UNION ALL
SELECT 'p', 'model.o' || k, k * 4 + 3, k, 'o', CASE WHEN k % 13 = 0 THEN 'ord' || k WHEN k % 4 = 0 THEN 'dim_o' || k ELSE 'fct_o' || k END,
 CASE WHEN k % 17 = 0 THEN 'models/misc/o' || k || '.sql' WHEN k % 13 = 0 THEN 'models/marts/ord' || k || '.sql' WHEN k % 4 = 0 THEN 'models/marts/dim_o' || k || '.sql' ELSE 'models/marts/fct_o' || k || '.sql' END,
 CASE WHEN k % 6 = 0 THEN 'incremental' WHEN k % 5 = 0 THEN 'view' ELSE 'table' END, {_CODE} FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM {{orders}}) o""",
    "sources": """
SELECT 'p' AS project_id, 'source.r' || r_regionkey AS source_id, CAST(r_regionkey AS BIGINT) AS idx, 'geo' AS source_name, 'region_' || lower(replace(r_name, ' ', '_')) AS name,
 CASE WHEN r_regionkey % 3 = 0 THEN '' ELSE 'a region' END AS description, CASE WHEN r_regionkey % 4 = 0 THEN '' ELSE 'raw' END AS schema_name,
 CASE WHEN r_regionkey % 2 = 1 THEN CAST(NULL AS STRING) ELSE 'loaded_at' END AS loaded_at_field, CASE WHEN r_regionkey % 2 = 0 THEN 'pii' ELSE '' END AS classification FROM {region}
UNION ALL
SELECT 'p', 'source.p' || p_partkey, CAST(p_partkey AS BIGINT) + 1000, CASE WHEN p_partkey % 3 = 0 THEN 'reorder' ELSE 'shop' END, 'part_' || p_partkey,
 CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END, CASE WHEN p_partkey % 2 = 1 THEN CAST(NULL AS STRING) ELSE 'at' END,
 CASE WHEN p_partkey % 5 = 0 THEN 'internal' ELSE '' END FROM {part}""",
    "edges": """
SELECT 'p' AS project_id, 'model.n' || n_nationkey AS child_id, 'source.r' || n_regionkey AS parent_id, CAST(0 AS BIGINT) AS pos, 'source' AS parent_kind FROM {nation}
UNION ALL SELECT 'p', 'model.n' || (p_partkey % 25), 'source.p' || p_partkey, CAST(p_partkey AS BIGINT), 'source' FROM {part} WHERE p_partkey % 20 = 0
UNION ALL SELECT 'p', 'model.n' || ((p_partkey + 1) % 25), 'source.p' || p_partkey, CAST(p_partkey AS BIGINT), 'source' FROM {part} WHERE p_partkey % 40 = 0
UNION ALL SELECT 'p', 'model.c' || c_custkey, 'model.n' || c_nationkey, CAST(0 AS BIGINT), 'model' FROM {customer}
UNION ALL SELECT 'p', 'model.n' || n_nationkey, 'model.n' || (n_nationkey - 1), CAST(5 AS BIGINT), 'model' FROM {nation} WHERE n_nationkey % 8 = 3
UNION ALL SELECT 'p', 'model.s' || s_suppkey, 'model.n' || s_nationkey, CAST(0 AS BIGINT), 'model' FROM {supplier}
UNION ALL SELECT 'p', 'model.o' || o_orderkey, 'model.c' || o_custkey, CAST(0 AS BIGINT), 'model' FROM {orders}
UNION ALL SELECT 'p', 'model.o' || o_orderkey, 'source.r' || (o_orderkey % 5), CAST(1 AS BIGINT), 'source' FROM {orders} WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'p', 'model.o' || o_orderkey, 'model.n' || (o_orderkey % 25), CAST(2 AS BIGINT), 'model' FROM {orders} WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'p', 'model.o' || o_orderkey, 'model.s' || (o_orderkey % 97 + 1), CAST(3 AS BIGINT), 'model' FROM {orders} WHERE o_orderkey % 5 = 0""",
    "columns": f"""
SELECT 'p' AS project_id, 'model.o' || l_orderkey AS model_id, CAST(l_linenumber AS BIGINT) AS pos, {_COLUMN} AS name, max(CASE WHEN l_linestatus = 'O' THEN 'd' ELSE ' ' END) AS description FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber""",
    "tests": f"""
SELECT 'p' AS project_id, 'model.o' || l_orderkey AS model_id, 'test.' || l_orderkey || '.' || l_linenumber AS test_id, CASE WHEN l_linenumber % 2 = 1 THEN 'Unique_c' ELSE 'not_null_c' END || l_linenumber AS name,
 {_COLUMN} AS column_name, CASE WHEN l_linenumber % 3 = 0 THEN 'unique' ELSE 'other' END AS test_type FROM {{lineitem}} WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber""",
    "exposures": """
SELECT 'p' AS project_id, 'exposure.o' || o_orderkey AS exposure_id, 'e' || o_orderkey AS name, 'model.o' || o_orderkey AS parent_id FROM {orders} WHERE o_orderkey % 3 = 0""",
    "yaml_files": "SELECT 'p' AS project_id, 'models/staging/_s.yml' AS path UNION ALL SELECT 'p', 'models/marts/_m.yml' UNION ALL SELECT 'p', 'models/intermediate/g3/_i.yaml'",
}
#: Flags of models, by arithmetic on their key.
FLAGS = {
    "description": "CASE WHEN k % 3 = 0 THEN ' ' ELSE 'text' END",
    "contract_enforced": 'k % 2 = 0',
    "access": "CASE WHEN k % 4 = 1 THEN 'public' ELSE 'private' END",
    "grp": "CASE WHEN k % 5 = 2 THEN 'core' ELSE '' END",
    "owner": "CASE WHEN k % 3 = 1 THEN 'ann' ELSE '' END",
    "team": "CASE WHEN k % 8 = 0 THEN 'x' ELSE 'null' END",
    "unique_key": "CASE WHEN k % 4 = 0 THEN 'id' ELSE '' END",
    "on_schema_change": "CASE WHEN k % 5 = 0 THEN 'fail' ELSE 'false' END",
    "partition_by": 'CASE WHEN k % 3 = 0 THEN \'{"field": "d"}\' ELSE \'{}\' END',
    "cluster_by": 'CASE WHEN k % 9 = 0 THEN \'["a"]\' ELSE \'[]\' END',
    "enabled": "CASE WHEN k % 19 = 0 THEN 'false' ELSE 'true' END",
    "tag": "CASE WHEN k % 10 = 0 THEN 'PII' ELSE 'daily' END",
}
STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def duckdb_ctes() -> str:
    """The catalog as common table expressions of DuckDB, with the layer spelt out."""
    names = {t: t for t in STAR}
    parts = [f"{name} AS ({sql.format(**names)})" for name, sql in TABLES.items()]
    layer = """CASE WHEN contains(lower(file_path), '/staging/') OR starts_with(lower(name), 'stg_') THEN 'staging' WHEN contains(lower(file_path), '/intermediate/') OR starts_with(lower(name), 'int_') THEN 'intermediate'
 WHEN contains(lower(file_path), '/marts/') OR starts_with(lower(name), 'fct_') OR starts_with(lower(name), 'dim_') THEN 'marts' ELSE 'other' END AS layer"""
    flags = ", ".join(f"{sql} AS {name}" for name, sql in FLAGS.items())
    parts.append(f"all_models AS (SELECT *, {layer}, {flags} FROM base_models)")
    parts.append("models AS (SELECT * FROM all_models WHERE NOT (starts_with(file_path, 'dbt_packages/') OR contains(file_path, '/dbt_packages/') OR starts_with(file_path, 'target/') OR contains(file_path, '/target/')))")
    return "WITH RECURSIVE " + ",\n".join(parts)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    tables = {t: table(spark, sf_dir, t) for t in STAR}

    def made(name: str) -> DataFrame:
        views = {}
        for t, df in tables.items():
            if f"{{{t}}}" in TABLES[name]:
                views[t] = f"quarry_{t}_{crc32(sf_dir.encode())}"
                df.createOrReplaceTempView(views[t])
        return spark.sql(TABLES[name].format(**views))

    base = made("base_models").selectExpr("*", *[f"{sql} AS {name}" for name, sql in FLAGS.items()])
    models = base.select(
        "project_id", "model_id", "idx", "name", "file_path", "materialization", "description", infer_layer(F.col("file_path"), F.col("name")).alias("layer"), "contract_enforced", "access", "grp",
        F.array("tag").alias("tags"), F.create_map(F.lit("owner"), F.col("owner"), F.lit("team"), F.col("team")).alias("meta"),
        F.create_map(*[x for k in ("unique_key", "on_schema_change", "partition_by", "cluster_by", "enabled") for x in (F.lit(k), F.col(k))]).alias("config"),
        "raw_code", F.lit(None).cast("string").alias("compiled_code"))
    sources = made("sources").select("project_id", "source_id", "idx", "source_name", "name", "description", "schema_name", F.lit("db").alias("database"), "loaded_at_field", F.lit(None).cast("string").alias("max_loaded_at"), F.array().cast("array<string>").alias("tags"), F.create_map(F.lit("data_classification"), F.col("classification")).alias("meta"))
    columns = made("columns").withColumn("data_type", F.lit(None).cast("string"))
    changed = models.filter("model_id like 'model.o%' and idx % 10 = 3").select("project_id", F.col("file_path").alias("path"))
    return Catalog(models, columns, made("tests"), sources, made("edges"), made("exposures"), yaml_files=made("yaml_files"), changed=changed)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of customers as if they were models: sets from the keys' remainders."""
    return table(spark, sf_dir, "customer").selectExpr(*PROFILE)


#: As PROFILE_SQL below, in Spark's array syntax.
PROFILE = [
    "'p' AS project_id", "'model.c' || c_custkey AS model_id", "CAST(c_custkey AS BIGINT) AS idx", "'int_cust' || c_custkey AS name", "'models/c' || c_custkey || '.sql' AS file_path",
    "CASE WHEN c_custkey % 3 = 0 THEN 'marts' ELSE 'intermediate' END AS layer",
    "CASE WHEN c_custkey % 29 = 0 THEN CAST(array() AS array<string>) ELSE array('n' || c_nationkey, 's' || c_mktsegment, 'm' || (c_custkey % 4)) END AS inputs",
    "array('a' || (c_custkey % 11), 'b' || (c_custkey % 7), 'n' || c_nationkey, 'id') AS selected",
    "CASE WHEN c_custkey % 2 = 0 THEN array('s' || c_mktsegment) ELSE CAST(array() AS array<string>) END AS join_targets",
    "array('f' || (c_custkey % 3)) AS filters", "array('g' || (c_custkey % 2)) AS group_by", "array('count', 'sum') AS aggregates", "CAST(array() AS array<string>) AS cte_names",
]
PROFILE_SQL = """
SELECT 'model.c' || c_custkey AS model_id, c_custkey AS idx, CASE WHEN c_custkey % 3 = 0 THEN 'marts' ELSE 'intermediate' END AS layer,
 CASE WHEN c_custkey % 29 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['n' || c_nationkey, 's' || c_mktsegment, 'm' || (c_custkey % 4)] END AS inputs,
 ['a' || (c_custkey % 11), 'b' || (c_custkey % 7), 'n' || c_nationkey, 'id'] AS selected,
 CASE WHEN c_custkey % 2 = 0 THEN ['s' || c_mktsegment] ELSE CAST([] AS VARCHAR[]) END AS join_targets,
 ['f' || (c_custkey % 3)] AS filters, ['g' || (c_custkey % 2)] AS group_by FROM customer"""


#: A model for each supplier, as the texts of a manifest: SQL that Spark and DuckDB read alike, over supplier s and nation n.
SUPPLIED = """SELECT 'int_s' || s_suppkey AS name, 'models/intermediate/int_s' || s_suppkey || '.sql' AS file_path, CAST(s_suppkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS region,
 'with base as (' || chr(10) || 'select s_id, s_name, s_balance, s_city, s_phone from {{{{ source(''geo'', ''r' || n_regionkey || ''') }}}} where s_balance > ' || (s_suppkey % 3) || chr(10) || '),' || chr(10) ||
 'tidy as (select s_id, s_name, s_balance as balance from base where s_phone is not null and s_city is not null)' || chr(10) || 'select s_id, s_name, balance, upper(s_name) as name_upper, balance * ' || (s_suppkey % 4) || ' as scaled from tidy' AS sql
 FROM {supplier} s JOIN {nation} n ON s_nationkey = n_nationkey"""


def manifest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest, as JSON text, with a model for each supplier and a source for each region."""
    views = {}
    for t in ("supplier", "nation", "region"):
        views[t] = f"quarry_{t}_{crc32(sf_dir.encode())}"
        table(spark, sf_dir, t).createOrReplaceTempView(views[t])
    model = F.struct(
        F.col("name"), F.lit("model").alias("resource_type"), F.col("file_path").alias("original_file_path"), F.col("sql").alias("raw_code"), F.concat(F.lit("model "), "k").alias("description"),
        F.create_map(F.lit("s_id"), F.struct(F.lit("s_id").alias("name"), F.lit("key").alias("description"))).alias("columns"), F.create_map(F.lit("materialized"), F.when(F.col("k") % 5 == 0, "table").otherwise("view")).alias("config"),
        F.struct(F.array(F.concat(F.lit("source.geo.r"), "region")).alias("nodes")).alias("depends_on"), F.array(F.lit("daily")).alias("tags"))
    nodes = spark.sql(SUPPLIED.format(**views)).select(F.struct(F.concat(F.lit("model.geo."), "name").alias("key"), model.alias("value")).alias("e")).agg(F.map_from_entries(F.array_sort(F.collect_list("e"), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))).alias("nodes"))
    source = F.struct(F.concat(F.lit("r"), "r_regionkey").alias("name"), F.lit("geo").alias("source_name"), F.col("r_name").alias("description"), F.lit("raw").alias("schema"))
    sources = spark.table(views["region"]).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("source.geo.r"), "r_regionkey").alias("key"), source.alias("value")))).alias("sources"))
    whole = F.struct(F.struct(F.lit("geo").alias("project_name")).alias("metadata"), "nodes", "sources")
    return nodes.join(sources).select(F.to_json(whole).alias("value"), F.lit("/geo/target/manifest.json").alias("path"))  # one row and one row
