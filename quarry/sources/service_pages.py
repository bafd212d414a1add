"""Pages of a metadata service as a Spark data source, and a store of them that can be gone on with.

Each environment and resource is a partition: cursors are followed on the executors and pages leave them as rows, so no list of pages is ever held in one place. ``pull`` reads
up to ``ROUND`` pages a partition at a time and appends them to a folder of Parquet; the next round, or the next run after a failure, starts from
the last cursor that the folder knows. A page that was asked for twice is stored once, as a round's files appear when all of it is there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..catalog import Catalog
from ..session import importable
from .manifest import parse_pages
from .service import FIELDS, LINEAGE, Service

FORMAT = "metadata_pages"
SCHEMA = "project_id string, environment bigint, resource string, page bigint, cursor string, more boolean, value string"
#: Pages that a partition reads in a round.
ROUND = 200
RESOURCES = [*FIELDS, "lineage"]


@dataclass
class Stretch(InputPartition):
    """Pages of a resource of an environment, from a page and its cursor on."""

    project_id: str
    environment: int
    resource: str
    page: int = 0
    cursor: str | None = None

    def __post_init__(self) -> None:
        super().__init__(None)


class PagesReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.url, self.token, self.most = options["url"], options.get("token"), int(options.get("pages", ROUND))
        self.stretches = [Stretch(**x) for x in json.loads(options["stretches"])]

    def partitions(self) -> list[Stretch]:
        return self.stretches

    def read(self, partition: Stretch) -> Iterator[tuple]:
        service, own = Service(self.token), (partition.project_id, partition.environment, partition.resource)
        if partition.resource == "lineage":
            yield (*own, 0, None, False, json.dumps(service.graphql(self.url, LINEAGE, {"environmentId": partition.environment})))
            return
        for i, (found, cursor) in enumerate(service.pages(self.url, partition.environment, partition.resource, partition.cursor)):
            yield (*own, partition.page + i, cursor, cursor is not None, json.dumps(found))
            if i + 1 == self.most:
                return


class Pages(DataSource):
    """Options: url; stretches, JSON of a list of ``Stretch``; pages, most of each; token, else that of the executors' environment."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)


def read_pages(spark: SparkSession, url: str, stretches: list[Stretch], token: str | None = None, pages: int = ROUND) -> DataFrame:
    importable(spark)
    spark.dataSource.register(Pages)
    told = [{"project_id": s.project_id, "environment": s.environment, "resource": s.resource, "page": s.page, "cursor": s.cursor} for s in stretches]
    reader = spark.read.format(FORMAT).option("url", url).option("stretches", json.dumps(told)).option("pages", str(pages))
    return (reader.option("token", token) if token else reader).load()


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """Pages in the folder ``store``; None before the first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(SCHEMA).parquet(store)


def pull(spark: SparkSession, url: str, environments: Mapping[int, str], store: str, token: str | None = None, pages: int = ROUND) -> DataFrame:
    """All pages of ``environments`` (id: project) in the folder ``store``, those that it lacks asked for now.

    The driver holds a row an environment and resource: where it stands.
    """
    todo = {(e, r): Stretch(project, e, r) for e, project in environments.items() for r in RESOURCES}
    while todo:
        known = stored(spark, store)
        if known is not None:
            last = known.groupBy("environment", "resource").agg(F.max(F.struct("page", "cursor", "more")).alias("x"))
            for row in last.collect():
                at = todo.get((row["environment"], row["resource"]))
                if at is not None and row["x"]["more"]:
                    at.page, at.cursor = row["x"]["page"] + 1, row["x"]["cursor"]
                else:
                    todo.pop((row["environment"], row["resource"]), None)
        if todo:
            read_pages(spark, url, list(todo.values()), token, pages).write.mode("append").parquet(store)
    return stored(spark, store).filter(F.col("environment").isin(list(environments)))


def read_service(spark: SparkSession, url: str, environments: Mapping[int, str], store: str, token: str | None = None) -> Catalog:
    """The catalog of deployed environments, each a project."""
    return parse_pages(pull(spark, url, environments, store, token), F.col("project_id"))
