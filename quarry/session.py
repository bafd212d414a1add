"""Session helpers: where cut lineage is written, and table readers."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HOME = str(Path(__file__).resolve().parents[1])


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor shares, as ``spark.checkpoint.dir`` names it.

    Only a local session may lack the setting; it then gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quarry_")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written_to(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it goes when the JVM ends."""
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = written_to(spark, name)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[made] = path
    return made


class appended:  # noqa: N801
    """A table that grows by rows appended to one folder, so all of it is one scan however many rounds there were."""

    def __init__(self, first: DataFrame, name: str) -> None:
        self.path, self.schema, self.parts = written_to(first.sparkSession, name), first.schema, 0
        self.spark = first.sparkSession
        self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        """Writes ``rows`` and gives them back as they are read."""
        rows.write.parquet(f"{self.path}/part={self.parts}")
        self.parts += 1
        return self.last()

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/part={self.parts - 1}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/part={i}" for i in range(self.parts)])


#: Folders of the tables that ``materialize`` has returned and that are still in use.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialize`` has written for these tables: for rounds that a later one, also written, has replaced."""
    for df in tables:
        if path := _WRITTEN.pop(df, None):
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if it is there on their machine."""
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, HOME])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
