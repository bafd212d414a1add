"""A small project manifest from end to end: catalog, rules, scores, sinks, review."""

import json

import pytest

from quarry import config
from quarry.operators import ai
from quarry.plans import scan
from quarry.registry import RULES
from quarry.sources import manifest, sinks


def model(name, folder, deps, **more):
    base = {"name": name, "resource_type": "model", "original_file_path": f"models/{folder}/{name}.sql", "description": "d", "raw_code": "", "columns": {}, "config": {"materialized": "view"}, "depends_on": {"nodes": deps}, "tags": [], "meta": {}}
    return {**base, **more}


def check(name, column, deps):
    return {"name": f"{name}_{column}", "resource_type": "test", "test_metadata": {"name": name}, "column_name": column, "depends_on": {"nodes": deps}}


CUSTOMERS = "with a as (\n  select * from {{ ref('stg_shop__orders') }}\n)\nselect * from a\n"
MANIFEST = {
    "metadata": {"project_name": "shop"},
    "nodes": {
        "model.shop.stg_shop__orders": model("stg_shop__orders", "staging", ["source.shop.shop.orders"], columns={"order_id": {"name": "order_id", "description": "key"}, "email": {"name": "email", "description": ""}}),
        "model.shop.int_orders": model("int_orders", "intermediate", ["model.shop.stg_shop__orders"], config={"materialized": "incremental", "unique_key": "id", "partition_by": {"field": "d"}}),
        "model.shop.fct_orders": model("fct_orders", "marts", ["model.shop.int_orders", "model.shop.stg_shop__orders"], description="", raw_code=CUSTOMERS, config={"materialized": "table", "contract": {"enforced": True}, "cluster_by": ["a"]}),
        "model.shop.bad": model("bad", "staging", ["model.shop.int_orders"], raw_code="INSERT INTO t\nselect 1 from prod.t", config={"materialized": "table", "enabled": False}),
        "test.shop.u": check("unique", "order_id", ["model.shop.stg_shop__orders"]),
        "test.shop.n": check("not_null", "order_id", ["model.shop.stg_shop__orders"]),
    },
    "sources": {"source.shop.shop.orders": {"name": "orders", "source_name": "shop", "schema": "", "description": "", "meta": {}}},
    "exposures": {"exposure.shop.e": {"name": "e", "depends_on": {"nodes": ["model.shop.fct_orders"]}}},
    "metrics": {},
}
EXPECTED = {
    "naming.staging_prefix": {"bad"}, "naming.source_schema_required": {"shop.orders"}, "structure.staging_refs_source_only": {"bad"}, "structure.no_cross_layer_skipping": {"fct_orders"}, "structure.no_orphan_models": {"bad"},
    "structure.no_rejoin_patterns": {"fct_orders"}, "testing.no_disabled_tests": {"bad"}, "testing.primary_key_test_required": {"int_orders", "fct_orders", "bad"}, "testing.minimum_test_coverage": {"int_orders", "fct_orders", "bad"},
    "testing.staging_freshness_required": {"shop.orders"}, "documentation.model_description_required": {"fct_orders"}, "documentation.source_description_required": {"shop.orders"}, "materialization.staging_must_be_view": {"bad"},
    "materialization.incremental_must_have_on_schema_change": {"int_orders"}, "style.no_select_star_in_marts": {"fct_orders"}, "migration.ddl_statements": {"bad"}, "migration.hardcoded_environment_schema": {"bad"}, "migration.no_ref_or_source": {"bad"},
    "security.pii_columns_tagged": {"stg_shop__orders"}, "security.privileged_access_policy": {"shop.orders"}, "governance.model_ownership_required": {"stg_shop__orders", "int_orders", "fct_orders", "bad"},
    "documentation.schema_yml_exists": {"models/staging", "models/intermediate", "models/marts"},
}


@pytest.fixture(scope="module")
def shop(spark):
    raw = spark.createDataFrame([(json.dumps(MANIFEST), "/x/manifest.json")], "value string, path string")
    return manifest.parse_manifests(raw).written()


def test_rules(shop):
    rows = scan.findings(shop, config.Config(), rules=[r for r in RULES if not r.startswith("reuse.")]).toPandas()
    got = {rule: set(own.model_name) for rule, own in rows.groupby("rule_id")}
    assert got == EXPECTED
    assert set(rows.severity) == {"warning"}
    line = rows[rows.rule_id == "migration.hardcoded_environment_schema"].line_number.iloc[0]
    assert line == 2


def test_config_turns_rules_off_and_grades_them(shop):
    conf = config.from_dict({"naming": {"rules": {"staging_prefix": {"severity": "error"}, "source_schema_required": False}}, "compat_mode": True})
    rows = scan.findings(shop, conf, categories=["naming", "governance"]).toPandas()
    assert set(zip(rows.rule_id, rows.severity, strict=True)) == {("naming.staging_prefix", "error")}
    with pytest.warns(UserWarning, match="unknown rule"):
        config.from_dict({"naming": {"rules": {"nonsense": True}}}, known=set(RULES))
    with pytest.raises(FileNotFoundError):
        config.load("/nowhere/x.yml")
    template = config.default_yaml([(r.rule_id, r.category, r.description) for r in RULES.values()])
    import yaml

    assert config.from_dict(yaml.safe_load(template), known=set(RULES)).enabled("naming.staging_prefix")


def test_scan_scores_and_sinks(shop):
    result = scan.scan(shop, config.Config(), categories=["naming", "style", "documentation"])
    scores = {r["category"]: r["score"] for r in result.scores.collect()}
    assert scores["naming"] == 50.0 and scores["style"] == 75.0 and scores["reuse"] == 100.0
    assert 0 <= result.overall.first()["score"] <= 100
    assert scan.exit_code(result, "error") == 0 and scan.exit_code(result, "warning") == 1 and scan.exit_code(result, "info") == 0 and scan.exit_code(result, "error", 99.9) == 1
    document = json.loads(sinks.sarif(result.findings))
    assert document["version"] == "2.1.0" and [r["id"] for r in document["runs"][0]["tool"]["driver"]["rules"]] == sorted({x["ruleId"] for x in document["runs"][0]["results"]})
    assert "locations" not in next(x for x in document["runs"][0]["results"] if x["ruleId"] == "naming.source_schema_required")
    notes = sinks.annotations(result.findings).collect()
    assert all(n["path"] for n in notes) and {n["line"] for n in notes} == {1}
    assert sinks.conclusion(result.findings) == "neutral"
    assert sinks.repository("https://host/own/name.git") == "own/name" and sinks.repository("a/b") == "a/b"
    assert "naming.staging_prefix" in sinks.text(result.findings, 50.0) and "# Review" in sinks.review_markdown(list(RULES), longest=4000)


def test_review(shop):
    def provider(prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return '```json\n[{"severity": "GRAVE", "message": "m"}]\n```'

    got = {(r["rule_id"], r["severity"], r["model_name"]) for r in ai.review(shop, provider).collect()}
    assert got == {("ai.review_error", "info", "bad"), ("ai.general", "warning", "fct_orders")}


def test_flagship_scores_every_category(spark):
    import __spark_entry__
    from quarry.plans import queries

    got = {r["category"]: r for r in __spark_entry__.entry(spark).collect()}
    assert {c for c in ("style", "migration", "reuse") if not got[c]["violations"]} == set()
    style = [r["model_name"] for rule in queries.RULES if rule.startswith("style.") for r in queries.rule_query(rule)(spark, "/root/testdata/sf0.001").collect()]
    assert (got["style"]["violations"], got["style"]["failing"]) == (len(style), len(set(style)))
