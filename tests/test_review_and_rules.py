"""Answers that are kept, their two forms, declared rules in a scan, roll-ups, and checks that share a plan."""

import json

import pytest
from pyspark.sql import functions as F

from quarry import cli, config
from quarry.operators import ai, custom, fused, providers, score
from quarry.plans import scan
from quarry.registry import RULES, Check, Settings, evaluate
from quarry.sources import sinks, testdata

SF = "/root/testdata/sf0.001"
ANSWERS = {
    '{"violations": []}': [], "[]": [], "nothing": [], '{"other": 1}': [], '{"message": "m"}': [], '[{"severity": "error"}]': [], '{"violations": [{"message": " "}]}': [], "": [],
    '{"violations": [{"rule_id": "ai.hardcoded_values", "severity": "Error", "message": "m"}, {"message": "n"}]}': [("ai.hardcoded_values", "error", "m"), ("ai.general", "warning", "n")],
    '```json\n{"violations": [{"message": "m", "severity": "info", "line_number": 3}]}\n```': [("ai.general", "info", "m")], '```\n[{"message": "m"}]\n```': [("ai.general", "warning", "m")], ' [{"message": "m", "more": {}}] ': [("ai.general", "warning", "m")],
}


def test_both_forms_of_answers(spark):
    rows = spark.createDataFrame([("p", f"m{i}", "f.sql", a, None) for i, a in enumerate(ANSWERS)], "project_id string, name string, file_path string, answer string, failed string")
    got = {}
    for r in ai.findings(rows).orderBy("message").collect():
        got.setdefault(r["model_name"], []).append((r["rule_id"], r["severity"], r["message"]))
    assert got == {f"m{i}": want for i, want in enumerate(ANSWERS.values()) if want}
    assert '"violations"' in providers.system_prompt()


def test_nothing_is_asked_twice(spark, tmp_path, monkeypatch):
    calls, store = str(tmp_path / "calls"), str(tmp_path / "answers")
    monkeypatch.setattr(ai, "ROUND", 4)
    monkeypatch.setattr(ai, "PAUSE", 0.0)
    rows = spark.createDataFrame([(str(i % 9), f"prompt {i % 9}") for i in range(18)], "prompt_id string, prompt string")

    def provider(broken):
        def ask(prompt):
            with open(calls, "a") as f:
                f.write(prompt + "\n")
            if broken and prompt.endswith("7"):
                raise ValueError("down")
            return ai.Reply(f"said {prompt}", 10, 2)

        return ask

    first = ai.asked(rows, provider(True), store, "one").collect()
    assert len(first) == 9 and {r["prompt_id"]: r["failed"] for r in first if r["failed"]} == {"7": "ValueError: down"}
    lines = open(calls).read().splitlines()
    assert len(lines) == 8 + ai.TRIES and len(set(lines)) == 9
    open(calls, "w").close()
    again = ai.asked(rows, provider(False), store, "one").collect()
    assert open(calls).read().splitlines() == ["prompt 7"] and {r["answer"] for r in again} == {f"said prompt {i}" for i in range(9)}
    assert ai.asked(rows.limit(2), provider(False), store, "two").count() == 1 or open(calls).read().count("\n") == 3
    kept = spark.read.parquet(store).filter("model = 'one'")
    assert ai.token_cost(kept, spark.createDataFrame([("one", 1e6, 0.0)], "model string, input double, output double")).first()["cost"] == 90.0


def test_declared_rules_run_in_a_scan(spark):
    own = config.from_dict({"custom_rules": [{"name": "no_union", "type": "regex", "pattern": "(?i)union all", "file_glob": "models/marts/*", "severity": "error", "description": "no unions", "suggestion": "join"}]})
    catalog = testdata.catalog(spark, SF)
    rows = scan.findings(catalog, own).filter("rule_id = 'custom.no_union'")
    want = custom.custom_findings(catalog, own.custom_rules[0])
    assert rows.count() == want.count() > 0 and rows.exceptAll(want).isEmpty()
    assert {(r["severity"], r["message"], r["suggestion"]) for r in rows.collect()} == {("error", "no unions", "join")}
    assert scan.findings(catalog, own, categories=["naming"]).filter("rule_id like 'custom%'").isEmpty()
    with pytest.raises(ValueError, match="pattern"):
        config.from_dict({"custom_rules": [{"name": "x"}]})
    with pytest.raises(ValueError, match="naming.nothing"):
        scan.findings(catalog, own, ["naming.nothing"])
    assert config.from_dict({"global": {"changed_files_only": True}}).changed_files_only


def test_checks_share_one_projection(spark):
    catalog, own = testdata.catalog(spark, SF).written(), config.Config()
    rules = [r for r in RULES.values() if isinstance(r.build(catalog, Settings(own, r.rule_id)), Check) and r.rule_id not in ("structure.max_dag_depth", "structure.no_rejoin_patterns")]
    assert len(rules) > 40
    together = evaluate(catalog, own, rules)
    scans = [x for x in together._jdf.queryExecution().sparkPlan().toString().splitlines() if "FileScan" in x]
    assert sum("raw_code" in x for x in scans) == 1  # one scan carries SQL, the others a few columns for side tables
    assert len(scans) < 30 < len(rules)
    together = together.cache()
    some = [r for r in rules if r.rule_id in ("structure.no_cross_layer_skipping", "migration.missing_source_definition", "testing.column_test_coverage", "testing.staging_freshness_required", "style.cte_pattern")]
    for r in some:
        alone = r.evaluate(catalog, own)
        part = together.filter(F.col("rule_id") == r.rule_id)
        assert alone.count() == part.count() > 0 and alone.exceptAll(part).isEmpty(), r.rule_id


def test_two_projects_do_not_mix(spark):
    one = testdata.catalog(spark, SF)
    names = ("models", "columns", "tests", "sources", "edges", "exposures", "yaml_files")
    both = type(one)(**{n: getattr(one, n).unionByName(getattr(one, n).withColumn("project_id", F.lit("q"))) for n in names})
    rules = [RULES[r] for r in ("structure.no_cross_layer_skipping", "reuse.duplicate_source_staging", "structure.max_fanout", "migration.missing_source_definition", "documentation.schema_yml_exists")]
    alone, mixed = evaluate(one, config.Config(), rules), evaluate(both, config.Config(), rules).cache()
    for p in ("p", "q"):
        part = mixed.filter(F.col("project_id") == p).withColumn("project_id", F.lit("p"))
        assert part.count() == alone.count() and part.exceptAll(alone).isEmpty()


def test_roll_ups_from_one_aggregate(spark):
    found = [("p", "naming.a", "error", "m1"), ("p", "naming.b", "info", "m1"), ("p", "style.c", "error", "m2"), ("q", "naming.a", "error", "m9"), ("p", "other.d", "info", "m3")]
    rows = spark.createDataFrame(found, "project_id string, rule_id string, severity string, model_name string")
    models = spark.createDataFrame([("p",)] * 4 + [("q",)] + [("r",)] * 2, "project_id string")
    rolled = score.rolled_up(rows, models).cache()
    assert {tuple(r) for r in score.severities_of(rolled).collect()} == {("p", "error", 2), ("p", "info", 2), ("q", "error", 1)} == {tuple(r) for r in score.by_severity(rows).collect()}
    got = {(r["project_id"], r["category"]): (r["models"], r["failing"], r["violations"], r["score"]) for r in score.scores_of(rolled).collect()}
    assert len(got) == 24 and got["p", "naming"] == (4, 1, 2, 75.0) and got["q", "naming"] == (1, 1, 1, 0.0) and got["r", "naming"] == (2, 0, 0, 100.0) and got["p", "style"] == (4, 1, 1, 75.0)
    assert {r["project_id"]: r["score"] for r in score.overall_of(rolled).collect()}["r"] == 100.0


def test_check_runs_and_reviews_need_their_settings(tmp_path, capsys):
    with pytest.raises(OSError, match="GITHUB_TOKEN, GITHUB_REPOSITORY"):
        sinks.check_caller({"GITHUB_SHA": "a"})
    calls = []
    revision, call = sinks.check_caller({"GITHUB_SHA": "abc", "GITHUB_TOKEN": "t", "GITHUB_REPOSITORY": "o/r"}, lambda *a: calls.append(a) or (200, b'{"id": 1}'))
    assert revision == "abc" and call("POST", "check-runs", {}) == {"id": 1} and calls[0][1] == "https://api.github.com/repos/o/r/check-runs"
    assert cli.main(["scan", "--project-dir", str(tmp_path), "--with-ai"]) == 1 and "--provider" in capsys.readouterr().err
    with pytest.raises(OSError, match="OPENAI_API_KEY"):
        providers.reviewer({"openai": {"enabled": True}}, "json:loads", {})
    assert providers.Named("builtins:max", "b")("a") == "b"
    assert cli.main(["generate", "terminal", "--file", str(tmp_path / "A.md")]) == 0 and "changed-only" in (tmp_path / "A.md").read_text()
    assert json.loads(ai.silent("")) == {"violations": []}


def test_bases_of_checks(spark):
    catalog = testdata.catalog(spark, SF)
    assert {"sql", "_lines", "_trimmed"} <= set(fused.base(catalog, "models", {"sql"}).columns) and "_name" in fused.base(catalog, "sources", set()).columns


def test_rounds_are_bounded(spark, tmp_path, monkeypatch):
    # With many prompts rounds grow longer and not more, and each reads its own prompts.
    monkeypatch.setattr(ai, "ROUND", 2)
    monkeypatch.setattr(ai, "MOST_ROUNDS", 3)
    names = []
    keep = ai.materialize
    monkeypatch.setattr(ai, "materialize", lambda df, name="cut": names.append(name) or keep(df, name))
    rows = spark.createDataFrame([(str(i), f"prompt {i}") for i in range(40)], "prompt_id string, prompt string")
    got = ai.asked(rows, lambda p: ai.Reply(f"said {p}", 1, 1), str(tmp_path / "answers"), "one").collect()
    assert {r["prompt_id"]: r["answer"] for r in got} == {str(i): f"said prompt {i}" for i in range(40)} and len(got) == 40
    assert names.count("told") == 3
