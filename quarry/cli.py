"""The terminal program: ``python -m quarry.cli scan|init|validate-config|rules|service|generate|version``."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from . import config as configs
from . import session
from .registry import RULES, rule_counts

VERSION = "2"


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _config(args: argparse.Namespace) -> configs.Config:
    return configs.load(args.config, getattr(args, "project_dir", "."), set(RULES))


def _address(own: configs.Config, args: argparse.Namespace) -> str | None:
    return args.service_url or own.service.get("discovery_api_url") or own.service.get("url")


def _place(own: configs.Config, args: argparse.Namespace) -> tuple[str, int]:
    """Address and environment of the metadata service: of the arguments, else of the configuration, which counts as switched on only with an address."""
    url = _address(own, args)
    environment = args.environment or own.service.get("environment_id")
    if not url or not environment:
        raise OSError("service mode needs an address and an environment: --service-url and --environment, or the configuration")
    return url, int(environment)


def _catalog(args: argparse.Namespace, own: configs.Config):
    from .sources import manifest, service_pages
    from .sources.service import TOKEN

    spark = _session()
    if args.pages:
        catalog = manifest.parse_pages(spark.read.text(args.pages, wholetext=True), args.project)
    elif args.service or (own.service.get("enabled") and _address(own, args) and not args.manifest and not args.local):
        url, environment = _place(own, args)
        if not os.environ.get(TOKEN):
            raise OSError(f"set {TOKEN} to a token of the service")
        store = args.store or session.written_to(spark, "pages")
        catalog = manifest.with_files(service_pages.read_service(spark, url, {environment: args.project}, store, os.environ[TOKEN]), spark, args.project_dir, args.project)
    else:
        found = args.manifest or str(Path(args.project_dir) / "target" / "manifest.json")
        if not Path(found).exists():
            raise FileNotFoundError(found)
        catalog = manifest.read_project(spark, args.project_dir, found)
    if args.changed_only or own.changed_files_only:
        first = catalog.models.select("project_id").first()
        catalog.changed = manifest.changed_files(spark, args.project_dir, first[0] if first else args.project)
    return catalog


def scan(args: argparse.Namespace) -> int:
    from .operators import providers
    from .plans import scan as plans
    from .sources import sinks

    own = _config(args)
    provider = None
    if args.with_ai or own.ai.get("enabled"):
        if not args.provider:
            raise OSError("a review needs --provider module:function, which answers prompts")
        provider = providers.reviewer(own.ai, args.provider)
    caller = sinks.check_caller(os.environ) if args.annotate else None
    result = plans.scan(_catalog(args, own), own, [x.strip() for x in args.rules.split(",")] if args.rules else None, args.changed_only or None, provider, args.answers)
    score = result.overall.first()
    kind = args.output or {".json": "json", ".sarif": "sarif"}.get(Path(args.output_file or "").suffix, "text")
    said = {"json": sinks.json_text, "sarif": sinks.sarif}[kind](result.findings) if kind != "text" else sinks.text(result.findings, score["score"] if score else 100.0)
    if args.output_file:
        Path(args.output_file).write_text(said, encoding="utf-8")
    else:
        print(said)
    if caller:
        print(f"check run: {sinks.check_run(result.findings, 'quarry', *caller)}", file=sys.stderr)
    return plans.exit_code(result, own.fail_on, args.fail_under)


def init(args: argparse.Namespace) -> int:
    at = Path(args.path or configs.FILES[0])
    if at.exists() and not args.force:
        print(f"{at} exists; --force replaces it", file=sys.stderr)
        return 1
    at.write_text(configs.default_yaml([(r.rule_id, r.category, r.description) for r in RULES.values()]), encoding="utf-8")
    print(f"{at} written")
    return 0


def validate(args: argparse.Namespace) -> int:
    own = _config(args)
    counts = rule_counts(own)
    print(f"{sum(counts['severities'].values())} rules are enabled: " + ", ".join(f"{n} {s}" for s, n in counts["severities"].items()))
    return 0


def rules(args: argparse.Namespace) -> int:
    own = _config(args)
    for r in RULES.values():
        if not args.category or r.category == args.category:
            print(f"{'on ' if own.enabled(r.rule_id) else 'off'} {own.severity(r.rule_id):8} {r.rule_id:50} {r.description}")
    return 0


def service(args: argparse.Namespace) -> int:
    from .sources.service import Admin, Service, listed_environments

    admin = Admin(args.url, args.account, Service())
    if args.action == "test":
        ok = admin.reachable()
        print("reachable" if ok else "not reachable")
        return 0 if ok else 1
    spark = _session()
    own = "id long, name string, project_id long, type string, deployment_type string"
    rows = [tuple(e.get(k) for k in ("id", "name", "project_id", "type", "deployment_type")) for e in admin.environments()]
    names = [(p.get("id"), p.get("name")) for p in admin.projects()]
    for r in listed_environments(spark.createDataFrame(rows, own), spark.createDataFrame(names, "id long, name string")).collect():
        print(f"{r['id']:>10} {r['type']:12} {r['project_name']} / {r['name']}")
    return 0


def generate(args: argparse.Namespace) -> int:
    from .sources import context

    own = _config(args)
    if args.what == "reuse":
        from .plans import scan as plans

        said = plans.reuse_text(_catalog(args, own), own)
    else:
        said = {"review": context.review, "context": context.project, "assistant": context.short, "terminal": context.terminal}[args.what](own)
    at = Path(args.file or {"review": "REVIEW.md", "context": "CONTEXT.md", "assistant": ".github/review-instructions.md", "terminal": "ASSISTANT.md", "reuse": "REUSE.md"}[args.what])
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(said, encoding="utf-8")
    print(f"{at} written")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry", description=__doc__)
    parts = top.add_subparsers(dest="command", required=True)

    def part(name: str, run, project: bool = False) -> argparse.ArgumentParser:
        own = parts.add_parser(name)
        own.set_defaults(run=run)
        own.add_argument("--config", "-c")
        own.add_argument("--project-dir", default=".")
        if project:
            own.add_argument("--manifest", "-m")
            own.add_argument("--pages", help="folder of stored pages of a metadata service, instead of a manifest")
            own.add_argument("--project", default="project")
            own.add_argument("--service", action="store_true", help="read the deployed environment from the metadata service")
            own.add_argument("--local", action="store_true", help="read a manifest even if the configuration enables the service")
            own.add_argument("--service-url")
            own.add_argument("--environment", type=int)
            own.add_argument("--store", help="folder that keeps pages of the service, to go on with after a failure")
            own.add_argument("--changed-only", action="store_true")
        return own

    one = part("scan", scan, True)
    one.add_argument("--rules", "-r", help="categories, comma-separated")
    one.add_argument("--output", "-o", choices=["json", "sarif", "text"])
    one.add_argument("--output-file")
    one.add_argument("--with-ai", action="store_true", help="review models after the rules")
    one.add_argument("--provider", help="module:function that answers a reviewer's instructions and a prompt")
    one.add_argument("--answers", help="folder that keeps answers, so nothing is asked twice")
    one.add_argument("--annotate", "--github-annotate", action="store_true", help="publish findings as a check run of the build's revision")
    one.add_argument("--fail-under", type=float)
    one = part("init", init)
    one.add_argument("path", nargs="?")
    one.add_argument("--force", action="store_true")
    part("validate-config", validate)
    part("rules", rules).add_argument("--category")
    one = part("service", service)
    one.add_argument("action", choices=["test", "environments"])
    one.add_argument("--url", required=True)
    one.add_argument("--account", type=int, required=True)
    one = part("generate", generate, True)
    one.add_argument("what", choices=["review", "context", "assistant", "terminal", "reuse"])
    one.add_argument("--file")
    part("version", lambda _: print(VERSION) or 0)
    return top


def main(argv: list[str] | None = None) -> int:
    from .plans import scan as _  # noqa: F401  (registers the rules)

    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
