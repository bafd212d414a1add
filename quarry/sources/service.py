"""Clients of a metadata service: pages of a GraphQL api, and the plain api of its administration.

The transport is a function, so tests and other libraries can take its place. ``service_pages`` reads pages on the executors.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Status and body of an answer to (method, url, headers, body).
Transport = Callable[[str, str, dict[str, str], bytes | None], tuple[int, bytes]]
TRIES, SECONDS, PAGE_SIZE = 3, 30.0, 500
TOKEN = "QUARRY_SERVICE_TOKEN"
#: Resources that come in pages, and the fields that are asked of each.
FIELDS = {
    "models": "uniqueId name filePath description materializedType contractEnforced access group tags meta rawCode compiledCode tests { name columnName } catalog { columns { name description type } }",
    "sources": "uniqueId name sourceName description schema database loadedAtField tags meta freshness { maxLoadedAt }",
    "exposures": "uniqueId name parents { uniqueId }",
}
LINEAGE = 'query ($environmentId: BigInt!) { environment(id: $environmentId) { applied { lineage(filter: { types: ["Model"] }) { uniqueId parentIds } } } }'


class ServiceError(RuntimeError):
    """The service has answered, and the answer is an error."""


def plain_transport(method: str, url: str, headers: dict[str, str], body: bytes | None) -> tuple[int, bytes]:
    request = urllib.request.Request(url, data=body, headers=headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=SECONDS) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


@dataclass
class Service:
    token: str | None = None
    transport: Transport = plain_transport

    def ask(self, method: str, url: str, body: Any = None) -> dict:
        """JSON of an answer; a failed connection or a status of 400 or more is tried again, TRIES times in all."""
        token = self.token or os.environ.get(TOKEN)
        if not token:
            raise OSError(f"set {TOKEN} to a token of the service")
        headers = {"authorization": f"Bearer {token}", "content-type": "application/json"}
        failure: Exception = ServiceError(url)
        for _ in range(TRIES):
            try:
                status, text = self.transport(method, url, headers, None if body is None else json.dumps(body).encode())
            except OSError as e:
                failure = e
                continue
            if status < 400:
                return json.loads(text)
            failure = ServiceError(f"{method} {url}: status {status}")
        raise failure

    def graphql(self, url: str, query: str, variables: dict[str, Any]) -> dict:
        found = self.ask("POST", url, {"query": query, "variables": variables})
        for error in found.get("errors") or []:
            more = error.get("extensions") or {}
            if more.get("code") == "NO_DATA_AVAILABLE":
                raise ServiceError(f"environment {more.get('id', '?')} has no data: it needs a deployment with a successful run")
        if found.get("errors"):
            raise ServiceError(f"errors: {found['errors']}")
        return found.get("data") or {}

    def pages(self, url: str, environment: int, resource: str, after: str | None = None) -> Iterator[tuple[dict, str | None]]:
        """Pages of a resource, following the cursor from ``after`` on, each with the cursor of the next; None says that it was the last."""
        query = f"query ($environmentId: BigInt!, $first: Int!, $after: String) {{ environment(id: $environmentId) {{ applied {{ {resource}(first: $first, after: $after) {{ edges {{ node {{ {FIELDS[resource]} }} }} pageInfo {{ hasNextPage endCursor }} }} }} }} }}"
        while True:
            page = self.graphql(url, query, {"environmentId": environment, "first": PAGE_SIZE} | ({"after": after} if after else {}))
            info = (((page.get("environment") or {}).get("applied") or {}).get(resource) or {}).get("pageInfo") or {}
            after = info.get("endCursor") if info.get("hasNextPage") else None
            yield page, after or None
            if not after:
                return


@dataclass
class Admin:
    """Projects, environments, jobs, runs and their artifacts."""

    base_url: str
    account: int
    service: Service

    def _data(self, path: str) -> Any:
        return self.service.ask("GET", f"{self.base_url.rstrip('/')}/api/v3/accounts/{self.account}/{path}").get("data")

    def projects(self) -> list[dict]:
        return self._data("projects/") or []

    def environments(self) -> list[dict]:
        return self._data("environments/") or []

    def environment(self, environment: int) -> dict:
        return self._data(f"environments/{environment}/") or {}

    def jobs(self, environment: int | None = None) -> list[dict]:
        return self._data("jobs/" + (f"?environment_id={environment}" if environment else "")) or []

    def last_run(self, job: int) -> dict | None:
        return next(iter(self._data(f"runs/?job_definition_id={job}&order_by=-created_at&limit=1") or []), None)

    def artifact(self, run: int, path: str = "manifest.json") -> dict:
        return self.service.ask("GET", f"{self.base_url.rstrip('/')}/api/v3/accounts/{self.account}/runs/{run}/artifacts/{path}")

    def reachable(self) -> bool:
        """Whether projects can be listed, which proves address, account and token."""
        try:
            self.projects()
        except (OSError, ValueError, RuntimeError):
            return False
        return True


def listed_environments(environments: DataFrame, projects: DataFrame) -> DataFrame:
    """``environments`` (id, name, project_id, type, deployment_type) with the names of ``projects`` (id, name): deployments first, then by project and name.

    A missing name is made of the id; a type is the deployment's kind, else its own, else ``deployment``.
    """
    named = projects.select(F.col("id").alias("project_id"), F.col("name").alias("_project"))
    rows = environments.join(named, "project_id", "left")
    kind = F.coalesce(F.nullif("deployment_type", F.lit("")), F.nullif("type", F.lit("")), F.lit("deployment"))
    out = rows.select(
        "id", F.coalesce("name", F.concat(F.lit("Environment "), F.col("id").cast("string"))).alias("name"), "project_id",
        F.coalesce("_project", F.concat(F.lit("Project "), F.col("project_id").cast("string"))).alias("project_name"), kind.alias("type"))
    return out.orderBy((F.col("type") == "development"), "project_name", "name")
