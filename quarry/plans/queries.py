"""The registered queries over the star-schema catalog, each with SQL that finds the same in other words."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import WEIGHTS, Config
from ..operators import graph, lineage_rules, models, score, similarity, text_rules  # noqa: F401  (they register rules)
from ..registry import RULES
from ..sources import testdata
from . import demo, reports
from .scan import findings

Query = Callable[[SparkSession, str], DataFrame]
#: Settings under which rules find something in the star-schema catalog.
#: Severities of categories that differ from the default.
GRADES = {"structure": "error", "security": "error", "documentation": "info"}
SETTINGS = Config(rules={r: {"severity": GRADES[r.split(".")[0]]} for r in RULES if r.split(".")[0] in GRADES})
SETTINGS.rules["governance.required_meta_fields"] = {"fields": ["owner", "team"]}
SETTINGS.rules["structure.max_dag_depth"] |= {"max_depth": 2}
LINES = {"style.no_hardcoded_schema", "style.refs_in_ctes_not_inline", "migration.ddl_statements", "migration.hardcoded_environment_schema", "migration.missing_source_definition"}


def rule_query(rule_id: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = RULES[rule_id].evaluate(testdata.catalog(spark, sf_dir), SETTINGS)
        return rows.select("model_name", "file_path", "message", *(["line_number"] if rule_id in LINES else []))

    return run


def _q(message: str, where: str, source: str = "models", name: str = "name", path: str = "file_path", line: str = "") -> str:
    return f"SELECT {name} AS model_name, {path} AS file_path, {message} AS message{f', CAST({line} AS INTEGER) AS line_number' if line else ''} FROM {source} WHERE {where}"


_LABEL = "source_name || '.' || name"
_SRC = {"source": "sources", "name": _LABEL, "path": "''"}
_CODE = "(SELECT * FROM models WHERE raw_code <> '') m"
_FIRST = """(SELECT name, file_path, min(ln) AS ln, arg_min(line, ln) AS line FROM (SELECT name, file_path, model_id, unnest(string_split(raw_code, chr(10))) AS line, generate_subscripts(string_split(raw_code, chr(10)), 1) AS ln FROM models WHERE raw_code <> '') l WHERE {} GROUP BY model_id, name, file_path) f"""
_PLAIN = "NOT contains(line, '{{') AND NOT contains(line, '{%')"
_PARENTS = "(SELECT e.child_id, string_agg(coalesce(t.label, e.parent_id), ', ' ORDER BY e.pos) AS parents FROM edges e LEFT JOIN (SELECT model_id AS id, name AS label FROM all_models UNION ALL SELECT source_id, source_name || '.' || name FROM sources) t ON t.id = e.parent_id WHERE e.parent_kind = '{}' GROUP BY e.child_id) x"
_UP = "up AS (SELECT child_id AS node_id, parent_id AS ancestor_id FROM edges UNION SELECT u.node_id, e.parent_id FROM up u JOIN edges e ON e.child_id = u.ancestor_id)"
_DEPTH = "paths AS (SELECT DISTINCT parent_id AS node_id, 0 AS depth FROM edges WHERE parent_id NOT IN (SELECT child_id FROM edges) UNION SELECT e.child_id, p.depth + 1 FROM paths p JOIN edges e ON e.parent_id = p.node_id), depths AS (SELECT node_id, max(depth) AS depth FROM paths GROUP BY node_id)"
_DIAMONDS = "dia AS (SELECT a.child_id AS node_id, a.parent_id AS left_id, b.parent_id AS right_id FROM edges a JOIN edges b ON a.child_id = b.child_id AND a.pos < b.pos WHERE EXISTS (SELECT 1 FROM up u JOIN up v ON u.ancestor_id = v.ancestor_id WHERE u.node_id = a.parent_id AND v.node_id = b.parent_id))"


_CIRCLES = """circular AS (SELECT child_id AS c, parent_id AS p FROM edges UNION SELECT parent_id, child_id FROM edges WHERE child_id LIKE 'model.c%' AND parent_id LIKE 'model.n%' AND CAST(substr(child_id, 8) AS BIGINT) % 40 = 0),
back AS (SELECT c, p FROM circular WHERE c IN (SELECT p FROM circular)), above AS (SELECT c AS a, p AS b FROM back UNION SELECT r.a, e.p FROM above r JOIN back e ON e.c = r.b),
nodes AS (SELECT c AS node_id FROM circular UNION SELECT p FROM circular), mutual AS (SELECT u.a, max(u.b) AS m, bool_or(u.b = u.a) AS looped FROM above u JOIN above v ON v.a = u.b AND v.b = u.a GROUP BY u.a),
component AS (SELECT node_id, greatest(node_id, coalesce(m, node_id)) AS component, coalesce(looped, false) AS looped FROM nodes LEFT JOIN mutual ON a = node_id)"""
_MERGED = """merged AS (SELECT DISTINCT x.component AS c, y.component AS p FROM circular JOIN component x ON x.node_id = c JOIN component y ON y.node_id = p WHERE x.component <> y.component),
longest AS (SELECT DISTINCT p AS node, CAST(0 AS BIGINT) AS d FROM merged WHERE p NOT IN (SELECT c FROM merged) UNION SELECT m.c, l.d + 1 FROM longest l JOIN merged m ON m.p = l.node)"""
_SEVERAL = """projects AS (SELECT 'p' || (idx % 7) AS project_id, count(*) AS models FROM all_models GROUP BY 1),
several AS (SELECT 'p' || (idx % 7) AS project_id, name, t.category, t.severity FROM models, (VALUES (1, 'naming', 'warning'), (2, 'documentation', 'info'), (3, 'materialization', 'warning'), (4, 'testing', 'warning'), (5, 'governance', 'warning')) t(rule, category, severity)
 WHERE CASE rule WHEN 1 THEN layer = 'marts' AND left(name, 4) NOT IN ('fct_', 'dim_') WHEN 2 THEN layer IN ('marts', 'intermediate') AND trim(description) = '' WHEN 3 THEN layer IN ('marts', 'intermediate') AND materialization = 'view'
 WHEN 4 THEN layer = 'marts' AND NOT contract_enforced ELSE access = 'public' AND NOT contract_enforced END)"""


def _inc(key: str, more: str = "") -> str:
    return _q(f"'Incremental model ''' || name || ''' sets no {key}'", f"materialization = 'incremental' AND {key} IN ('', '[]', '{{}}', 'false', 'null', '0') {more}")


def _shared(staging: bool, text: str) -> str:
    uses = f"(SELECT DISTINCT m.model_id, m.name, m.file_path, e.parent_id FROM models m JOIN edges e ON e.child_id = m.model_id WHERE e.parent_kind = 'source' AND m.layer {'=' if staging else '<>'} 'staging')"
    return f"SELECT u.name AS model_name, u.file_path, {text} AS message FROM {uses} u JOIN (SELECT parent_id, count(*) AS n FROM {uses} v GROUP BY parent_id HAVING count(*) > 1) c USING (parent_id) LEFT JOIN sources s ON s.source_id = u.parent_id"


#: DuckDB SQL of each rule, after the catalog's common table expressions.
CHECKS: dict[str, str] = {
    "naming.staging_prefix": _q("'Staging model ''' || name || ''' does not follow stg_<source>__<entity>'", "layer = 'staging' AND NOT regexp_matches(name, '^stg_[a-z0-9_]+__[a-z0-9_]+$')"),
    "naming.intermediate_prefix": _q("'Intermediate model ''' || name || ''' does not start with int_'", "layer = 'intermediate' AND name NOT LIKE 'int\\_%' ESCAPE '\\'"),
    "naming.marts_prefix": _q("'Marts model ''' || name || ''' starts with neither fct_ nor dim_'", "layer = 'marts' AND left(name, 4) NOT IN ('fct_', 'dim_')"),
    "naming.source_schema_required": _q(f"'Source ''' || {_LABEL} || ''' has no schema'", "schema_name = ''", **_SRC),
    "naming.model_file_matches_name": _q("'Model ''' || name || ''' is in a file named ''' || parse_filename(file_path, true) || ''''", "parse_filename(file_path, true) <> name"),
    "structure.model_directories_match_layers": "SELECT name AS model_name, file_path, 'Model ''' || name || ''' should be under ' || dir || '/' AS message FROM (SELECT *, CASE left(name, 4) WHEN 'stg_' THEN 'staging' WHEN 'int_' THEN 'intermediate' WHEN 'fct_' THEN 'marts' WHEN 'dim_' THEN 'marts' END AS dir FROM models) m WHERE dir IS NOT NULL AND NOT contains(file_path, '/' || dir || '/') AND NOT starts_with(file_path, dir || '/')",
    "testing.marts_have_contract": _q("'Marts model ''' || name || ''' does not enforce a contract'", "layer = 'marts' AND NOT contract_enforced"),
    "testing.no_disabled_tests": _q("'Model ''' || name || ''' is disabled'", "enabled = 'false'"),
    "documentation.model_description_required": _q("'Model ''' || name || ''' has no description'", "layer IN ('marts', 'intermediate') AND trim(description) = ''"),
    "documentation.source_description_required": _q(f"'Source ''' || {_LABEL} || ''' has no description'", "trim(coalesce(description, '')) = ''", **_SRC),
    "materialization.staging_must_be_view": _q("'Staging model ''' || name || ''' is materialized as ' || materialization", "layer = 'staging' AND materialization NOT IN ('view', 'ephemeral')"),
    "materialization.incremental_must_have_unique_key": _inc("unique_key"),
    "materialization.incremental_must_have_on_schema_change": _inc("on_schema_change"),
    "materialization.incremental_requires_partition": _inc("partition_by", "AND layer <> 'staging'"),
    "materialization.marts_not_view": _q("upper(left(layer, 1)) || substr(layer, 2) || ' model ''' || name || ''' is a view'", "layer IN ('marts', 'intermediate') AND materialization = 'view'"),
    "materialization.table_requires_cluster_by": _q("'Marts model ''' || name || ''' sets no cluster_by'", "layer = 'marts' AND materialization IN ('table', 'incremental') AND cluster_by = '[]'"),
    "migration.no_layering": _q("'Model ''' || name || ''' belongs to no layer'", "NOT regexp_matches(name, '(?i)^(stg_|int_|fct_|dim_)') AND NOT regexp_matches(file_path, '(?i)/(staging|intermediate|marts|mart)/')"),
    "governance.model_ownership_required": _q("'Model ''' || name || ''' has neither owner nor group'", "owner = '' AND grp = ''"),
    "governance.public_models_need_contract": _q("'Public model ''' || name || ''' does not enforce a contract'", "access = 'public' AND NOT contract_enforced"),
    "governance.required_meta_fields": _q("'Model ''' || name || ''' lacks meta fields: ' || CASE WHEN owner = '' AND team = 'null' THEN 'owner, team' WHEN owner = '' THEN 'owner' ELSE 'team' END", "owner = '' OR team = 'null'"),
    "security.privileged_access_policy": _q(f"'Source ''' || {_LABEL} || ''' seems to hold personal or business data but has no classification'", "classification = '' AND regexp_matches(lower(name || ' ' || source_name), '" + "|".join(models.PRIVILEGED) + "')", **_SRC),
    "style.cte_pattern": _q("'Model ''' || name || ''' imports by ref() or source() after CTEs with logic'", "len(imp) >= 2 AND list_position(imp, false) > 0 AND list_contains(list_slice(imp, list_position(imp, false), len(imp)), true)", r"(SELECT *, list_transform(list_slice(string_split_regex(raw_code, '(?i)\b\w+\s+as\s*\('), 2, 1000000), lambda x: regexp_matches(split_part(x, chr(10) || ')', 1), '\{\{\s*(ref|source)\s*\(')) AS imp FROM models WHERE raw_code <> '') m"),
    "style.no_hardcoded_schema": _q("'Model ''' || name || ''' names database, schema and table on line ' || ln", "true", _FIRST.format(_PLAIN + r" AND regexp_matches(line, '(?i)(from|join)\s+\w+\.\w+\.\w+')"), line="ln"),
    "style.no_select_star_in_marts": _q("'Marts model ''' || name || ''' ends in SELECT *'", r"layer = 'marts' AND regexp_matches(reverse(split_part(reverse(lower(raw_code)), 'tceles', 1)), '^\s+\*')", _CODE),
    "style.final_select_from_named_cte": "SELECT name AS model_name, file_path, 'Model ''' || name || ''' reads ref() or source() in its last SELECT' AS message FROM (SELECT name, file_path, model_id, arg_max(line, ln) AS line FROM (SELECT name, file_path, model_id, unnest(string_split(raw_code, chr(10))) AS line, generate_subscripts(string_split(raw_code, chr(10)), 1) AS ln FROM models WHERE contains(raw_code, 'with')) l WHERE starts_with(lower(trim(line)), 'from') OR starts_with(lower(trim(line)), 'join') GROUP BY ALL) f WHERE regexp_matches(line, '\\{\\{\\s*(ref|source)\\s*\\(')",
    "style.refs_in_ctes_not_inline": _q("'Model ''' || name || ''' joins ref() on line ' || ln", "true", _FIRST.format(r"regexp_matches(line, '(?i)join\s+\{\{\s*ref\s*\(')"), line="ln"),
    "migration.no_ref_or_source": _q("'Model ''' || name || ''' calls neither ref() nor source()'", "length(trim(raw_code, ' ' || chr(10))) >= 20 AND NOT regexp_matches(raw_code, '(?i)[{][{]\\s*(ref|source)\\s*[(]')", _CODE),
    "migration.ddl_statements": _q("'Model ''' || name || ''' has a ' || upper(split_part(trim(line), ' ', 1)) || ' statement on line ' || ln", "true", _FIRST.format(r"regexp_matches(line, '(?i)^\s*(create\s+(or\s+replace\s+)?(table|view|temporary\s+table)|insert\s+(into|overwrite)|truncate\s|drop\s+(table|view)|alter\s+table|merge\s+into|update\s+\w+\s+set|delete\s+from)')"), line="ln"),
    "migration.hardcoded_environment_schema": _q("'Model ''' || name || ''' names a schema of one environment on line ' || ln", "true", _FIRST.format(_PLAIN + r""" AND regexp_matches(line, '(?i)(from|join)\s+[''"`]?(""" + "|".join(text_rules.SCHEMAS) + r""")[''"`]?\.')"""), line="ln"),
    "migration.missing_source_definition": _q("'Model ''' || name || ''' calls source(''' || s || ''', ''' || t || '''), which is not defined'", "NOT EXISTS (SELECT 1 FROM sources d WHERE lower(d.source_name) = s AND lower(d.name) = t)", r"(SELECT name, file_path, ln, lower(regexp_extract(c, '[''\x22](\w+)[''\x22]\s*,', 1)) AS s, lower(regexp_extract(c, ',\s*[''\x22](\w+)[''\x22]', 1)) AS t FROM (SELECT name, file_path, ln, unnest(regexp_extract_all(line, '\{\{\s*source\s*\([^)]*\)')) AS c FROM (SELECT name, file_path, unnest(string_split(raw_code, chr(10))) AS line, generate_subscripts(string_split(raw_code, chr(10)), 1) AS ln FROM models) l) q) z", line="ln"),
    "security.no_hardcoded_credentials": _q("'Model ''' || name || ''' seems to hold credentials (' || hits || ' patterns)'", "hits > 0", "(SELECT *, " + " + ".join(f"CAST(regexp_matches(raw_code, '(?i)({w})\\s*[=:]\\s*[''\"][^''\"]{{{n},}}[''\"]') AS INTEGER)" for w, n in (("password|passwd|pwd", 4), ("api_key|apikey|api_secret|secret_key|access_key|private_key", 8))) + " AS hits FROM models) m"),
    "structure.staging_refs_source_only": _q("'Staging model ''' || name || ''' reads models: ' || parents", "layer = 'staging'", "models m JOIN " + _PARENTS.format("model") + " ON x.child_id = m.model_id"),
    "structure.marts_no_source_refs": _q("'Marts model ''' || name || ''' reads sources: ' || parents", "layer = 'marts'", "models m JOIN " + _PARENTS.format("source") + " ON x.child_id = m.model_id"),
    "structure.no_cross_layer_skipping": "SELECT m.name AS model_name, m.file_path, 'Marts model ''' || m.name || ''' reads staging model ''' || s.name || '''' AS message FROM models m JOIN edges e ON e.child_id = m.model_id JOIN all_models s ON s.model_id = e.parent_id WHERE m.layer = 'marts' AND s.layer = 'staging'",
    "structure.no_orphan_models": _q("'Model ''' || name || ''' is read by no model and no exposure'", "NOT EXISTS (SELECT 1 FROM edges e WHERE e.parent_id = m.model_id) AND NOT EXISTS (SELECT 1 FROM exposures x WHERE x.parent_id = m.model_id)", "models m"),
    "structure.max_fanout": _q("'Model ''' || name || ''' has ' || n || ' direct readers, more than 10'", "n > 10", "models m JOIN (SELECT parent_id, count(DISTINCT child_id) AS n FROM edges GROUP BY parent_id) f ON f.parent_id = m.model_id"),
    "structure.max_dag_depth": _q("'Model ''' || name || ''' is ' || depth || ' deep, more than 2'", "depth > 2", "models m JOIN depths d ON d.node_id = m.model_id"),
    "structure.no_rejoin_patterns": "SELECT m.name AS model_name, m.file_path, 'Model ''' || m.name || ''' joins ''' || coalesce(l.name, left_id) || ''' and ''' || coalesce(r.name, right_id) || ''', which share an ancestor' AS message FROM dia JOIN models m ON m.model_id = dia.node_id LEFT JOIN all_models l ON l.model_id = left_id LEFT JOIN all_models r ON r.model_id = right_id",
    "testing.primary_key_test_required": _q("'Model ''' || name || ''' lacks key tests: ' || CASE WHEN u AND NOT n THEN 'not_null' WHEN n AND NOT u THEN 'unique' ELSE 'unique, not_null' END", "NOT (u AND n)", "(SELECT m.name, m.file_path, coalesce(bool_or(contains(lower(t.name), 'unique') OR t.test_type = 'unique'), false) AS u, coalesce(bool_or(contains(lower(t.name), 'not_null')), false) AS n FROM models m LEFT JOIN tests t ON t.model_id = m.model_id GROUP BY m.model_id, m.name, m.file_path) q"),
    "testing.minimum_test_coverage": _q("'Model ''' || name || ''' has ' || n || ' tests, fewer than 2'", "n < 2", "(SELECT m.name, m.file_path, count(t.test_id) AS n FROM models m LEFT JOIN tests t ON t.model_id = m.model_id GROUP BY m.model_id, m.name, m.file_path) q"),
    "testing.staging_freshness_required": _q(f"'Source ''' || {_LABEL} || ''' has no freshness'", "coalesce(loaded_at_field, '') = '' AND source_id IN (SELECT e.parent_id FROM edges e JOIN all_models m ON m.model_id = e.child_id WHERE m.layer = 'staging')", **_SRC),
    "testing.column_test_coverage": _q("'Model ''' || name || ''' tests ' || CAST(floor(w * 100.0 / a) AS INTEGER) || '% of its columns (' || w || ' of ' || a || ')'", "w < 0.5 * a", "(SELECT m.name, m.file_path, count(DISTINCT c.name) AS a, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM tests t WHERE t.model_id = c.model_id AND t.column_name = c.name) THEN c.name END) AS w FROM models m JOIN columns c ON c.model_id = m.model_id GROUP BY m.model_id, m.name, m.file_path) q"),
    "documentation.column_description_required": _q("'Model ''' || name || ''' has columns without description: ' || array_to_string(list_slice(b, 1, 5), ', ') || CASE WHEN len(b) > 5 THEN '...' ELSE '' END", "layer = 'marts'", "models m JOIN (SELECT model_id, list(name ORDER BY pos) AS b FROM columns WHERE trim(description) = '' GROUP BY model_id) c ON c.model_id = m.model_id").replace("|| name ||", "|| m.name ||").replace("SELECT name", "SELECT m.name"),
    "documentation.schema_yml_exists": "SELECT DISTINCT parse_dirpath(file_path) AS model_name, parse_dirpath(file_path) AS file_path, 'Directory ''' || parse_dirpath(file_path) || ''' has models but no YAML file' AS message FROM models WHERE parse_dirpath(file_path) NOT IN (SELECT parse_dirpath(path) FROM yaml_files)",
    "security.pii_columns_tagged": _q("'Model ''' || m.name || ''' has columns that look personal: ' || array_to_string(list_slice(b, 1, 5), ', ') || CASE WHEN len(b) > 5 THEN ' (+' || (len(b) - 5) || ' more)' ELSE '' END", "tag <> 'PII'", "models m JOIN (SELECT model_id, list(name ORDER BY pos) AS b FROM columns WHERE regexp_matches(name, '^(" + "|".join(lineage_rules.PERSONAL) + ")$|_(" + "|".join(lineage_rules.PERSONAL) + ")$|^(" + "|".join(lineage_rules.PERSONAL) + ")_') GROUP BY model_id) c ON c.model_id = m.model_id", name="m.name"),
    "reuse.duplicate_source_staging": _shared(True, "'Staging model ''' || u.name || ''' stages source ''' || coalesce(s.source_name || '.' || s.name, u.parent_id) || ''', as do ' || (c.n - 1) || ' others'"),
    "reuse.multiple_models_from_same_source": _shared(False, "'Model ''' || u.name || ''' reads source ''' || coalesce(s.source_name || '.' || s.name, u.parent_id) || ''' directly, as do ' || (c.n - 1) || ' others'"),
}


#: Further common table expressions that the SQL of a rule reads.
NEEDS = {"structure.max_dag_depth": f", {_DEPTH}", "structure.no_rejoin_patterns": f", {_UP}, {_DIAMONDS}"}


def dag_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(testdata.catalog(spark, sf_dir).edges).select("node_id", "ancestor_id")


def dag_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.descendant_counts(testdata.catalog(spark, sf_dir).edges).select("node_id", "descendants")


def dag_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depth(testdata.catalog(spark, sf_dir).edges).select("node_id", F.col("depth").cast("long").alias("depth"))


def dag_diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.diamonds(testdata.catalog(spark, sf_dir).edges).select("node_id", "left_id", "right_id")


def dag_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fanout(testdata.catalog(spark, sf_dir).edges).select("node_id", "children")


def _circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineage, in which nations also read some of their customers: what is read in a circle is one component."""
    edges = testdata.catalog(spark, sf_dir).edges
    key = F.substring("child_id", 8, 20).cast("long")
    back = edges.filter(F.col("child_id").startswith("model.c") & F.col("parent_id").startswith("model.n") & (key % 40 == 0))
    return edges.unionByName(back.select("project_id", F.col("parent_id").alias("child_id"), F.col("child_id").alias("parent_id"), "pos", "parent_kind"))


def dag_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(_circular(spark, sf_dir)).select("node_id", "component")


def dag_depth_with_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depth(_circular(spark, sf_dir)).select("node_id", F.col("depth").cast("long").alias("depth"))


#: Rules of the roll-up over several projects, and by which remainder of the key a model belongs to which.
SEVERAL, PROJECTS = ["naming.marts_prefix", "documentation.model_description_required", "materialization.marts_not_view", "testing.marts_have_contract", "governance.public_models_need_contract"], 7


def _several(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = testdata.catalog(spark, sf_dir)
    models = own.models.withColumn("project_id", F.concat(F.lit("p"), F.col("idx") % PROJECTS))
    return findings(replace(own, models=models), SETTINGS, SEVERAL), models


def project_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.category_scores(*_several(spark, sf_dir)).select("project_id", "category", "models", "failing", "violations", "passing", "score")


def project_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.severities_of(score.rolled_up(*_several(spark, sf_dir)))


def _groups(spark: SparkSession, sf_dir: str) -> similarity.Groups:
    return similarity.groups_of(similarity.similar_kinds(testdata.profiles(spark, sf_dir)))


def sim_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(testdata.profiles(spark, sf_dir)).select("left_id", "right_id", F.size("shared_inputs").cast("long").alias("shared_inputs"), F.size("shared_columns").cast("long").alias("shared_columns"), F.round("score", 6).alias("score"))


def sim_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.linked_models(_groups(spark, sf_dir)).select("model_id", "cluster_id")


def rule_model_similarity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.clusters_of(_groups(spark, sf_dir)).select("cluster_id", "size", "links")


def rule_model_similarity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.greedy(similarity.similar_pairs(testdata.profiles(spark, sf_dir))).select("left_id", "right_id")


def rule_identical_select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.identical_selects(testdata.profiles(spark, sf_dir), least_columns=4)
    return rows.select("model_id", F.col("others").cast("long").alias("others"))


def reuse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _groups(spark, sf_dir)
    return similarity.reuse_report_of(own, similarity.clusters_of(own)).select("kind", "n_models", "priority", F.round("score", 6).alias("score"))


#: Rules that make up the roll-ups: all but those on parsed SQL, which have queries of their own.
ROLLED = list(CHECKS)


def _rolled(spark: SparkSession, sf_dir: str):
    c = testdata.catalog(spark, sf_dir).written()
    # Counts are made of findings as they are found: they are read once, without their texts.
    return c, findings(c, SETTINGS, ROLLED, texts=False)


def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir)[1].groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("findings"))


def violations_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.by_severity(_rolled(spark, sf_dir)[1]).select("severity", "findings")


def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, rows = _rolled(spark, sf_dir)
    return score.category_scores(rows, c.models).select("category", "models", "failing", "violations", "passing", "score")


def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, rows = _rolled(spark, sf_dir)
    return score.overall_score(score.category_scores(rows, c.models)).select("score")


def changed_file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, rows = _rolled(spark, sf_dir)
    return score.changed_only(rows, c.changed).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))


def whole_category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``category_scores``, of every registered rule, those on parsed SQL too. Not a registered query, as SQL can't parse SQL."""
    c = testdata.catalog(spark, sf_dir).written()
    return score.category_scores(findings(c, SETTINGS), c.models).select("category", "models", "failing", "violations", "passing")


_ROLLED = f"{_DEPTH}, {_UP}, {_DIAMONDS}, found AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{SETTINGS.severity(r)}' AS severity, model_name, file_path FROM ({CHECKS[r]}) q{i}" for i, r in enumerate(ROLLED)) + ")"
_CATS = """cats(category, weight) AS (VALUES {}), n AS (SELECT count(*) AS models FROM all_models),
rolled AS (SELECT category, weight, models, coalesce(failing, 0) AS failing, coalesce(violations, 0) AS violations, greatest(0, models - coalesce(failing, 0)) AS passing FROM cats CROSS JOIN n LEFT JOIN (SELECT split_part(rule_id, '.', 1) AS category, count(DISTINCT model_name) AS failing, count(*) AS violations FROM found GROUP BY 1) f USING (category)),
scored AS (SELECT *, round_even(CAST(100 * passing AS DOUBLE) / models, 1) AS score FROM rolled)""".format(", ".join(f"('{c}', CAST({w} AS DOUBLE))" for c, w in WEIGHTS.items()))
_SIM = f""", prof AS ({testdata.PROFILE_SQL}), scored AS (SELECT a.model_id AS left_id, b.model_id AS right_id, len(list_intersect(a.inputs, b.inputs)) AS shared_inputs, len(list_intersect(a.selected, b.selected)) AS shared_columns,
 {{}} FROM prof a JOIN prof b ON a.layer = b.layer AND a.idx < b.idx), parts AS (SELECT *, i * 0.28e0 + s * 0.24e0 + j * 0.14e0 + f * 0.10e0 + g * 0.08e0 + 0.08e0 + 0.08e0 AS score FROM scored), pairs AS (SELECT * FROM parts WHERE score >= 0.72e0 AND NOT (i < 0.34e0 AND s < 0.50e0))"""


def _jac(c: str, name: str) -> str:
    both = f"len(list_intersect(a.{c}, b.{c}))"
    return f"CASE WHEN len(a.{c}) + len(b.{c}) = 0 THEN 1.0e0 ELSE CAST({both} AS DOUBLE) / (len(a.{c}) + len(b.{c}) - {both}) END AS {name}"


_PAIRS = _SIM.format(", ".join(_jac(c, n) for c, n in (("inputs", "i"), ("selected", "s"), ("join_targets", "j"), ("filters", "f"), ("group_by", "g"))))
_COMPONENTS = ", both_ways AS (SELECT left_id AS a, right_id AS b FROM pairs UNION SELECT right_id, left_id FROM pairs), reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b), placed AS (SELECT a AS model_id, least(a, min(b)) AS cluster_id FROM reach GROUP BY a)"

QUERIES: dict[str, Query] = {f"rule_{r.split('.')[1]}": rule_query(r) for r in CHECKS} | {
    f.__name__: f
    for f in (
        dag_ancestors, dag_descendants, dag_depth, dag_diamonds, dag_fanout, dag_cycles, dag_depth_with_cycles, project_scores, project_severities, sim_edges, sim_clusters, rule_model_similarity_clusters, rule_model_similarity_candidates,
        rule_identical_select_columns, reuse_report, findings_by_rule, violations_by_severity, category_scores, overall_score, changed_file_findings,
    )
} | demo.QUERIES | reports.QUERIES


def _sql() -> dict[str, str]:
    head = testdata.duckdb_ctes()
    out = {f"rule_{r.split('.')[1]}": f"{head}{NEEDS.get(r, '')}\n{sql}" for r, sql in CHECKS.items()}
    out |= {
        "dag_ancestors": f"{head}, {_UP} SELECT node_id, ancestor_id FROM up",
        "dag_descendants": f"{head}, {_UP} SELECT ancestor_id AS node_id, count(*) AS descendants FROM up GROUP BY 1",
        "dag_depth": f"{head}, {_DEPTH} SELECT node_id, CAST(depth AS BIGINT) AS depth FROM depths",
        "dag_diamonds": f"{head}, {_UP}, {_DIAMONDS} SELECT node_id, left_id, right_id FROM dia",
        "dag_cycles": f"{head}, {_CIRCLES} SELECT node_id, component FROM component WHERE looped",
        "dag_depth_with_cycles": f"{head}, {_CIRCLES}, {_MERGED} SELECT node_id, coalesce(d, 0) AS depth FROM component LEFT JOIN (SELECT node AS component, max(d) AS d FROM longest GROUP BY node) l USING (component)",
        "project_scores": f"{head}, {_SEVERAL}, cats(category) AS (VALUES {', '.join(f"('{c}')" for c in WEIGHTS)}), failed AS (SELECT project_id, category, count(DISTINCT name) AS failing, count(*) AS violations FROM several GROUP BY ALL) SELECT project_id, category, models, coalesce(failing, 0) AS failing, coalesce(violations, 0) AS violations, greatest(0, models - coalesce(failing, 0)) AS passing, round_even(CAST(100 * greatest(0, models - coalesce(failing, 0)) AS DOUBLE) / models, 1) AS score FROM projects CROSS JOIN cats LEFT JOIN failed USING (project_id, category)",
        "project_severities": f"{head}, {_SEVERAL} SELECT project_id, severity, count(*) AS findings FROM several GROUP BY ALL",
        "dag_fanout": f"{head} SELECT parent_id AS node_id, count(DISTINCT child_id) AS children FROM edges GROUP BY 1",
        "sim_edges": f"{head}{_PAIRS} SELECT left_id, right_id, CAST(shared_inputs AS BIGINT) AS shared_inputs, CAST(shared_columns AS BIGINT) AS shared_columns, round(score, 6) AS score FROM pairs",
        "sim_clusters": f"{head}{_PAIRS}{_COMPONENTS} SELECT model_id, cluster_id FROM placed",
        "rule_model_similarity_clusters": f"{head}{_PAIRS}{_COMPONENTS} SELECT p.cluster_id, count(*) AS size, any_value(l.n) AS links FROM placed p JOIN (SELECT cluster_id, count(*) AS n FROM pairs JOIN placed ON model_id = left_id GROUP BY 1) l USING (cluster_id) GROUP BY p.cluster_id HAVING count(*) >= 3",
        "rule_identical_select_columns": f"{head}, prof AS ({testdata.PROFILE_SQL}) SELECT model_id, n - 1 AS others FROM (SELECT model_id, count(*) OVER (PARTITION BY list_sort(inputs), list_sort(selected), layer) AS n FROM prof WHERE len(selected) >= 4) q WHERE n >= 2",
        "reuse_report": f"""{head}{_PAIRS}{_COMPONENTS}, big AS (SELECT cluster_id, count(*) AS size FROM placed GROUP BY 1 HAVING count(*) >= 3), ends AS (SELECT score, cluster_id FROM pairs JOIN placed ON model_id = left_id), one AS (SELECT size, avg(score) AS score FROM ends JOIN big USING (cluster_id) GROUP BY cluster_id, size)
SELECT 'cluster' AS kind, size AS n_models, CASE WHEN score >= 0.82e0 OR size >= 4 THEN 'high' ELSE 'medium' END AS priority, round(score, 6) AS score FROM one
UNION ALL SELECT 'pair', 2, CASE WHEN score >= 0.88e0 THEN 'high' WHEN score >= 0.70e0 THEN 'medium' ELSE 'low' END, round(score, 6) FROM ends WHERE cluster_id NOT IN (SELECT cluster_id FROM big)""",
        "findings_by_rule": f"{head}, {_ROLLED} SELECT rule_id, severity, count(*) AS findings FROM found GROUP BY 1, 2",
        "violations_by_severity": f"{head}, {_ROLLED} SELECT severity, count(*) AS findings FROM found GROUP BY 1",
        "overall_score": f"{head}, {_ROLLED}, {_CATS} SELECT round_even(sum(score * weight) / sum(weight), 1) AS score FROM scored",
        "category_scores": f"{head}, {_ROLLED}, {_CATS} SELECT category, models, failing, violations, passing, score FROM scored",
        "changed_file_findings": f"{head}, {_ROLLED}, changed AS (SELECT DISTINCT file_path AS p FROM all_models WHERE kind = 'o' AND idx % 10 = 3), hit AS (SELECT p FROM changed UNION SELECT parse_dirpath(p) FROM changed) SELECT rule_id, count(*) AS findings FROM found WHERE file_path IN (SELECT p FROM hit) GROUP BY 1",
    }
    return out | demo.SQL | reports.SQL


SQL = _sql()
