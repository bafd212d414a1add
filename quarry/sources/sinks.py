"""What a scan is written as: JSON, SARIF, annotation batches, markdown, sorted text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from ..registry import RULES
from ..session import materialize
from .service import Service, Transport, plain_transport

BATCH, LONGEST = 50, 65_000


def level(severity: Column) -> Column:
    """SARIF level of a severity."""
    return F.when(severity == "error", "error").when(severity == "warning", "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result a finding, as JSON; locations only where there is a path."""
    place = F.when(F.coalesce("file_path", F.lit("")) != "", F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.coalesce("line_number", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))))
    result = F.struct(F.col("rule_id").alias("ruleId"), level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"), F.struct("model_name", "suggestion").alias("properties"))
    return findings.select("project_id", "rule_id", level(F.col("severity")).alias("level"), place.isNotNull().alias("located"), F.to_json(result).alias("result"))


def sarif_parts(findings: DataFrame, tool: str = "quarry", version: str = "1") -> Iterator[str]:
    """A SARIF 2.1.0 document of one run, piece by piece: results are made on the executors, and the driver holds a partition of them at a time."""
    rows = materialize(sarif_results(findings), "results")
    names = [r["rule_id"] for r in rows.select("rule_id").distinct().orderBy("rule_id").collect()]
    rules = [{"id": r, "shortDescription": {"text": RULES[r].description if r in RULES else r}, "defaultConfiguration": {"level": {"error": "error", "warning": "warning"}.get(RULES[r].default_severity if r in RULES else "info", "note")}} for r in names]
    head = json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "version": version, "rules": rules}}, "results": []}]})
    start, end = head.rsplit("[]", 1)
    yield start + "["
    for i, r in enumerate(rows.orderBy("rule_id", "result").toLocalIterator()):
        yield (",\n" if i else "\n") + r["result"]
    yield "]" + end


def sarif(findings: DataFrame, tool: str = "quarry", version: str = "1") -> str:
    return "".join(sarif_parts(findings, tool, version))


def write_sarif(findings: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(sarif_parts(findings))


def write_json(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def json_text(findings: DataFrame) -> str:
    """Findings as one JSON list, in order. A report for people: its size is that of the findings."""
    rows = findings.orderBy("severity", "rule_id", "model_name", "message").select(F.to_json(F.struct(*findings.columns)).alias("row")).toLocalIterator()
    return "[" + ",\n".join(r["row"] for r in rows) + "]\n"


def annotations(findings: DataFrame) -> DataFrame:
    """Annotations of a check run in batches of BATCH a project: path, line (1 by default), level, message, batch."""
    grade = F.when(F.col("severity") == "error", "failure").when(F.col("severity") == "warning", "warning").otherwise("notice")
    rows = numbered(findings.filter(F.coalesce("file_path", F.lit("")) != ""), ["severity", "rule_id", "file_path", "model_name", "message"], "_rank")
    return rows.select("project_id", F.col("file_path").alias("path"), F.coalesce("line_number", F.lit(1)).alias("line"), grade.alias("annotation_level"), F.left("message", F.lit(LONGEST)).alias("message"), F.col("rule_id").alias("title"), F.floor((F.col("_rank") - 1) / BATCH).alias("batch"))


def conclusion(findings: DataFrame) -> str:
    """failure with errors, neutral with other findings, else success."""
    if not findings.filter("severity = 'error'").isEmpty():
        return "failure"
    return "success" if findings.isEmpty() else "neutral"


def repository(name: str) -> str | None:
    """owner/repo of a url or such a name."""
    found = re.search(r"(?:^|[/:])([\w.-]+)/([\w.-]+?)(?:\.git)?/?$", name.strip())
    return f"{found[1]}/{found[2]}" if found else None


def send(findings: DataFrame, post: Callable[[str, int, list], None]) -> None:
    """Hands each batch to ``post`` (project, batch, annotations) from the driver, a batch in memory at a time."""
    batch: list = []
    at = None
    for row in annotations(findings).orderBy("project_id", "batch").toLocalIterator():
        if at is not None and at != (row["project_id"], row["batch"]):
            post(*at, batch)
            batch = []
        at = (row["project_id"], row["batch"])
        batch.append(row.asDict())
    if at is not None:
        post(*at, batch)


def summary(findings: DataFrame, shown: int = 20) -> str:
    """How many findings there are of each severity, and the first ones."""
    counts = {r["severity"]: r["count"] for r in findings.groupBy("severity").count().collect()}
    rows = findings.orderBy("severity", "rule_id", "model_name", "message").limit(shown).collect()
    more = sum(counts.values()) - len(rows)
    lines = [", ".join(f"{counts.get(s, 0)} {s}" for s in ("error", "warning", "info")), "", *[f"- `{r['rule_id']}` {r['model_name']}: {r['message']}" for r in rows]]
    return "\n".join(lines + ([f"... and {more} more"] if more > 0 else []))


def check_run(findings: DataFrame, name: str, revision: str, call: Callable[[str, str, dict], dict]) -> str | None:
    """Publishes a check run through ``call`` (method, path, body) and returns its address.

    The first batch of annotations goes with POST, each further one with PATCH to the run that the answer names.
    """
    output = {"title": name, "summary": summary(findings)}
    body = {"name": name, "head_sha": revision, "status": "completed", "conclusion": conclusion(findings), "output": {**output, "annotations": []}}
    made: dict = {}

    def post(project: str, batch: int, rows: list) -> None:
        marks = [{"path": r["path"], "start_line": r["line"], "end_line": r["line"], "annotation_level": r["annotation_level"], "message": r["message"], "title": r["title"]} for r in rows]
        if made:
            call("PATCH", f"check-runs/{made['id']}", {"output": {**output, "annotations": marks}})
        else:
            made.update(call("POST", "check-runs", {**body, "output": {**output, "annotations": marks}}))

    send(findings, post)
    if not made:
        made.update(call("POST", "check-runs", body))
    return made.get("html_url")


def check_caller(environ: Mapping[str, str], transport: Transport = plain_transport) -> tuple[str, Callable[[str, str, dict], dict]]:
    """Revision and ``call`` of ``check_run`` as a build's environment tells them; an error names what is not set."""
    missing = [v for v in ("GITHUB_TOKEN", "GITHUB_REPOSITORY", "GITHUB_SHA") if not environ.get(v)]
    if missing:
        raise OSError(f"set {', '.join(missing)} to publish a check run")
    base = f"{environ.get('GITHUB_API_URL', 'https://api.github.com').rstrip('/')}/repos/{repository(environ['GITHUB_REPOSITORY'])}"
    service = Service(environ["GITHUB_TOKEN"], transport)
    return environ["GITHUB_SHA"], lambda method, path, body: service.ask(method, f"{base}/{path}", body)


def band(score: float) -> str:
    return "excellent" if score >= 90 else "good" if score >= 75 else "fair" if score >= 60 else "poor"


def text(findings: DataFrame, overall: float, most: int | None = None) -> str:
    """Findings for a terminal, by severity as a word, then rule: all, or the first ``most`` and how many more there are."""
    ordered = findings.orderBy("severity", "rule_id", "model_name", "message")
    rows = (ordered if most is None else ordered.limit(most)).collect()
    more = 0 if most is None or len(rows) < most else findings.count() - len(rows)
    lines = [f"Score {overall:.1f} ({band(overall)})"]
    lines += [f"{r['severity']:8} {r['rule_id']:45} {r['model_name']}: {r['message']}" for r in rows]
    return "\n".join(lines + ([f"... and {more} more"] if more else []))


def review_markdown(rules: list[str], custom: list[dict] | None = None, longest: int | None = None) -> str:
    """A checklist of rules for reviewers. ``longest`` cuts it, for tools with a bound on instructions."""
    lines = ["# Review checklist", ""]
    for category in sorted({r.split(".")[0] for r in rules}):
        lines += [f"## {category.capitalize()}", ""]
        lines += [f"- {RULES[r].description} (`{r}`)" for r in rules if r.startswith(category + ".") and r in RULES] + [""]
    lines += ["## Own rules", "", *[f"- {c.get('description', c.get('id', ''))}" for c in custom], ""] if custom else []
    out = "\n".join(lines)
    return out if longest is None or len(out) <= longest else out[: longest - 100].rsplit("\n", 1)[0] + "\n\n(shortened)\n"


def reuse_markdown(report: DataFrame) -> str:
    rows = report.orderBy("project_id", "rank").collect()
    lines = ["# Reuse report", "", f"{len(rows)} recommendations", ""]
    return "\n".join(lines + [f"{r['rank']}. **{r['priority']}** {r['kind']} of {r['n_models']} models ({r['score']:.2f}): {r['models']}" for r in rows])
