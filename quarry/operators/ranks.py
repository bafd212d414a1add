"""Numbers of rows in an order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialize


def numbered(rows: DataFrame, order: list[str], name: str, by: str = "project_id") -> DataFrame:
    """``rows`` with their number from 1 on among those of the same ``by``, in the ``order`` of columns.

    Rows are dealt out by ranges of the order. Each range numbers its own and adds the counts of those before it, of which there are as many as partitions.
    """
    ranged = rows.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    counts = ranged.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy(by, "_range").orderBy(*order))
    offsets = counts.select(by, "_range", before.alias("_before"))
    return ranged.withColumn("_own", own).join(offsets, [by, "_range"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_own", "_before", "_range")
