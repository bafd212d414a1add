"""The terminal program, service clients, generated files, providers, check runs and settings."""

import json

import pytest

from quarry import cli, config
from quarry.operators import ai, custom, providers
from quarry.plans import scan
from quarry.registry import RULES, rule_counts
from quarry.sources import context, manifest, service, sinks

from test_project import MANIFEST


@pytest.fixture
def project(tmp_path):
    (tmp_path / "target").mkdir()
    (tmp_path / "target" / "manifest.json").write_text(json.dumps(MANIFEST))
    at = tmp_path / "models" / "marts"
    at.mkdir(parents=True)
    (at / "fct_orders.sql").write_text("select *\nfrom {{ ref('int_orders') }}\njoin {{ ref('stg_shop__orders') }} on true\n")
    (at / "_m.yml").write_text("version: 2\nmodels:\n  - name: fct_orders\n    meta: {owner: ann}\n")
    (at / "_none.yml").write_text("# only a comment\n---\n")
    (tmp_path / "shop_project.yml").write_text("name: shop\n")
    own = "project: {name: Shop, description: Orders and such}\nnaming:\n  rules:\n    staging_prefix: {severity: error}\nreuse: {enabled: false}\nglobal: {fail_on: error}\nservice: {enabled: true, environment_id: 67890}\n"
    (tmp_path / ".quarry.yml").write_text(own)
    return tmp_path


def test_scan_from_the_terminal(spark, project, capsys):
    out = project / "out.json"
    assert cli.main(["scan", "--project-dir", str(project), "--output-file", str(out), "--rules", "naming,style"]) == 1
    rows = json.loads(out.read_text())
    assert {r["rule_id"] for r in rows} >= {"naming.staging_prefix", "style.refs_in_ctes_not_inline"} and {r["rule_id"].split(".")[0] for r in rows} == {"naming", "style"}
    assert [r["severity"] for r in rows if r["rule_id"] == "naming.staging_prefix"] == ["error"]
    assert cli.main(["scan", "--project-dir", str(project), "--rules", "documentation", "--output", "sarif"]) == 0
    said = capsys.readouterr().out
    assert json.loads(said[said.index("{") :])["runs"][0]["results"]
    assert cli.main(["scan", "--project-dir", str(project), "--rules", "documentation", "--fail-under", "99.9"]) == 1
    assert cli.main(["scan", "--manifest", str(project / "none.json")]) == 1
    assert manifest.project_settings(str(project)) == {"name": "shop"} and manifest.project_settings(str(project / "models")) == {}


def test_sources_from_disk(spark, project):
    own = manifest.read_project(spark, str(project), str(project / "target" / "manifest.json"))
    assert [r["path"] for r in own.sql_files.collect()] == ["models/marts/fct_orders.sql"]
    assert [r["path"] for r in own.yaml_files.collect()] == ["models/marts/_m.yml"]
    assert own.models.filter("name = 'fct_orders'").first()["raw_code"].startswith("select *\nfrom")
    has = {"id": "owned", "type": "yaml_key_exists", "key": "models.meta.owner", "glob": "models/*"}
    assert custom.custom_findings(own, has).count() == 0
    assert [r["file_path"] for r in custom.custom_findings(own, {**has, "key": "models.meta.team"}).collect()] == ["models/marts/_m.yml"]
    own.changed = spark.createDataFrame([("shop", "models/staging/bad.sql")], "project_id string, path string")
    asked = ai.review(own, lambda p: '[{"message": "m"}]', changed_only=True)
    assert [r["model_name"] for r in asked.collect()] == ["bad"]


def test_files_and_counts(project, capsys):
    for what, part in (("review", "Shop"), ("context", "`67890`"), ("assistant", "Errors block")):
        at = project / "made" / f"{what}.md"
        assert cli.main(["generate", what, "--project-dir", str(project), "--file", str(at)]) == 0 and part in at.read_text()
    own = config.load(root=str(project), known=set(RULES))
    text = context.project(own)
    assert "staging to intermediate to marts" in text and "stg_{source}__{entity}" in text and "CI fails on `error` severity or higher." in text
    for k in range(60):
        own.custom_rules.append({"id": f"c{k}", "description": "a rule of the team that takes some room " * 3})
    assert len(context.short(own)) <= context.LONGEST and "Cut to 4,000" in context.short(own)
    counts = rule_counts(own)
    assert counts["severities"]["error"] == 1 and counts["categories"]["reuse"] == 0 and sum(counts["severities"].values()) == sum(counts["categories"].values())
    at = project / "new.yml"
    assert cli.main(["init", str(at)]) == 0 and cli.main(["init", str(at)]) == 1 and cli.main(["validate-config", "--config", str(at)]) == 0
    assert cli.main(["rules", "--category", "naming"]) == 0 and cli.main(["version"]) == 0
    assert "naming.staging_prefix" in capsys.readouterr().out


def test_providers():
    own = {"provider": "openai", "model": "m1", "openai": {"enabled": True, "models": ["m2"]}, "gemini": {"enabled": True, "models": ["g1", "g2"], "api_key_env_var": "MINE"}}
    assert [(t.provider, t.model) for t in providers.targets(own)] == [("openai", "m1"), ("openai", "m2"), ("gemini", "g1"), ("gemini", "g2")]
    assert providers.enabled_providers({}) == ["anthropic"]
    with pytest.raises(OSError, match="MINE"):
        providers.required_keys(own, {"OPENAI_API_KEY": "k"})
    assert providers.required_keys(own, {"OPENAI_API_KEY": "k", "MINE": "j"}) == {"openai": "k", "gemini": "j"}
    assert providers.first_with_key({"provider": "gemini"}, {"ANTHROPIC_API_KEY": "k"}) == "anthropic" and providers.first_with_key({}, {}) is None
    assert "house rules" in providers.system_prompt(" house rules ") and "ai.general" in providers.system_prompt()


def test_service_pages_and_tries(spark):
    calls = []

    def transport(method, url, headers, body):
        calls.append((method, url))
        if len(calls) == 1:
            raise ConnectionError("down")
        if len(calls) == 2:
            return 503, b""
        asked = json.loads(body)
        assert headers["authorization"] == "Bearer t"
        for resource in service.FIELDS:
            if f"{resource}(first" in asked["query"]:
                after = asked["variables"].get("after")
                node = {"uniqueId": f"model.p.m{after or 0}", "name": f"stg_m{after or 0}", "filePath": "models/staging/a.sql"} if resource == "models" else {"uniqueId": "source.p.s", "name": "s", "sourceName": "x"} if resource == "sources" else {"uniqueId": "e", "name": "e", "parents": []}
                more = resource == "models" and not after
                return 200, json.dumps({"data": {"environment": {"applied": {resource: {"edges": [{"node": node}], "pageInfo": {"hasNextPage": more, "endCursor": "1"}}}}}}).encode()
        return 200, json.dumps({"data": {"environment": {"applied": {"lineage": [{"uniqueId": "model.p.m1", "parentIds": ["model.p.m0"]}]}}}}).encode()

    own = service.Service("t", transport)
    pages = [page for resource in service.FIELDS for page, _ in own.pages("https://x/graphql", 5, resource)]
    assert [len(p["environment"]["applied"]) for p in pages] == [1] * 4 and len(calls) == 2 + 4
    answers = iter([(500, b"")] * 3 + [(200, b'{"errors": [{"extensions": {"code": "NO_DATA_AVAILABLE", "id": 7}}]}')])
    failing = service.Service("t", lambda *a: next(answers))
    with pytest.raises(service.ServiceError, match="500"):
        failing.ask("GET", "u")
    with pytest.raises(service.ServiceError, match="environment 7 has no data"):
        failing.graphql("u", "q", {})
    assert not service.Admin("https://x", 1, service.Service("t", lambda *a: (401, b""))).reachable()


def test_admin_and_environments(spark, monkeypatch, capsys):
    data = {"projects/": [{"id": 1, "name": "shop"}], "environments/": [{"id": 9, "name": "dev", "project_id": 1, "type": "development"}, {"id": 8, "name": None, "project_id": 2, "type": "deployment", "deployment_type": ""}, {"id": 7, "name": "prod", "project_id": 1, "type": "deployment", "deployment_type": "production"}], "jobs/?environment_id=7": [{"id": 3}], "runs/?job_definition_id=3&order_by=-created_at&limit=1": [{"id": 4}]}

    def transport(method, url, headers, body):
        path = url.split("/accounts/5/")[1]
        return 200, json.dumps({"nodes": {}} if "artifacts" in path else {"data": data.get(path, {})}).encode()

    admin = service.Admin("https://x/", 5, service.Service("t", transport))
    assert admin.reachable() and admin.jobs(7) == [{"id": 3}] and admin.last_run(3) == {"id": 4} and admin.artifact(4) == {"nodes": {}} and admin.environment(7) == {}
    monkeypatch.setattr(service, "plain_transport", transport)
    monkeypatch.setattr(service.Service, "__init__", lambda self, token="t", transport=transport: self.__dict__.update(token=token, transport=transport))
    assert cli.main(["service", "environments", "--url", "https://x", "--account", "5"]) == 0
    said = [x.split(None, 2) for x in capsys.readouterr().out.strip().splitlines()]
    assert [(x[0], x[1]) for x in said] == [("8", "deployment"), ("7", "production"), ("9", "development")]


def test_check_run_in_batches(spark):
    from pyspark.sql import functions as F

    rows = spark.range(120).select(F.lit("p").alias("project_id"), F.lit("naming.x").alias("rule_id"), F.lit("warning").alias("severity"), F.concat(F.lit("m"), "id").alias("model_name"), F.lit("a.sql").alias("file_path"), F.lit(None).cast("int").alias("line_number"), F.lit("text").alias("message"), F.lit("").alias("suggestion"))
    calls = []
    at = sinks.check_run(rows, "quarry", "abc", lambda method, path, body: calls.append((method, path, body)) or {"id": 1, "html_url": "u"})
    assert at == "u" and [(m, p, len(b["output"]["annotations"])) for m, p, b in calls] == [("POST", "check-runs", 50), ("PATCH", "check-runs/1", 50), ("PATCH", "check-runs/1", 20)]
    assert calls[0][2]["conclusion"] == "neutral" and calls[0][2]["output"]["summary"].count("\n- ") == 20 and "100 more" in calls[0][2]["output"]["summary"]
    assert sinks.check_run(rows.limit(0), "quarry", "abc", lambda *a: {"html_url": "v"}) == "v"
    assert "... and 110 more" in sinks.text(rows, 80.0, 10) and len(sinks.text(rows, 80.0).splitlines()) == 121


def test_base_refs():
    assert manifest.base_refs({"GITHUB_BASE_REF": "dev", "CI_MERGE_REQUEST_TARGET_BRANCH_NAME": "up/next"}) == ["origin/dev", "up/next", "origin/main", "origin/master"]


def test_exit_codes_follow_severity(spark, project):
    own = config.Config(rules={"naming.staging_prefix": {"severity": "info"}})
    result = scan.scan(manifest.read_project(spark, str(project), str(project / "target" / "manifest.json")), own, ["naming"])
    assert scan.exit_code(result, "error") == 0 and scan.exit_code(result, "warning") == 1 and scan.exit_code(result, "info") == 0


def test_roll_ups_make_no_texts(spark, monkeypatch):
    from quarry.catalog import COUNTED
    from quarry.plans import queries as own
    from quarry.sources import testdata

    rules = ["naming.marts_prefix", "migration.missing_source_definition", "naming.source_schema_required", "style.no_hardcoded_schema"]
    c = testdata.catalog(spark, "/root/testdata/sf0.001")
    lean, whole = own.findings(c, own.SETTINGS, rules, texts=False), own.findings(c, own.SETTINGS, rules)
    assert lean.columns == COUNTED and sorted(map(str, lean.collect())) == sorted(map(str, whole.select(*COUNTED).collect()))
    assert "does not" not in lean._jdf.queryExecution().optimizedPlan().toString() and "names database" not in lean._jdf.queryExecution().optimizedPlan().toString()
