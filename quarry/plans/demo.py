"""Analytic shapes that the scanned projects themselves hold, run over the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def _money(name: str):
    return F.round(F.sum(F.col(name).cast("decimal(18,2)")), 2).cast("double")


def _by_period(period: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
        return rows.groupBy(F.date_format(F.date_trunc(period, "o_orderdate"), "yyyy-MM-dd").alias("period"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"), _money("o_totalprice").alias("total"))

    return run


def demo_payment_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), _money("l_extendedprice").alias("amount"))


def demo_dim_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), _money("o_totalprice").alias("total"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(spent, "c_custkey", "left")
    return rows.withColumns({"n_orders": F.coalesce("n_orders", F.lit(0)), "total": F.coalesce("total", F.lit(0.0))})


def demo_fct_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "O") & (F.col("o_totalprice") > 0)).select("o_orderkey", "o_custkey", "o_orderstatus")


def demo_fct_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 10")
    return rows.groupBy(F.date_format(F.date_trunc("month", "l_shipdate"), "yyyy-MM-dd").alias("month")).agg(F.count(F.lit(1)).alias("n"), _money("l_extendedprice").alias("revenue"))


def demo_stg_orders_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_totalprice between 1000 and 200000")
    return rows.select("o_orderkey", F.upper("o_orderpriority").alias("priority"), F.round(F.col("o_totalprice").cast("decimal(18,2)") * 100, 0).cast("long").alias("cents"))


def demo_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice").cast("decimal(18,2)")).otherwise(0)).cast("double").alias(f"total_{s.lower()}")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(spent("F"), spent("O"), spent("P"))


def demo_customers_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(nations, "c_nationkey", "left").select("c_custkey", "n_name", "c_mktsegment")


_SUM = "CAST(round(sum(CAST({} AS DECIMAL(18,2))), 2) AS DOUBLE)"


def _period_sql(period: str) -> str:
    return f"SELECT strftime(date_trunc('{period}', o_orderdate), '%Y-%m-%d') AS period, o_orderpriority, count(*) AS n_orders, {_SUM.format('o_totalprice')} AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2"


QUERIES = {
    "demo_orders_daily": _by_period("day"), "demo_orders_weekly": _by_period("week"), "demo_orders_monthly": _by_period("month"), "demo_payment_analysis": demo_payment_analysis, "demo_dim_customers": demo_dim_customers,
    "demo_fct_orders": demo_fct_orders, "demo_fct_revenue": demo_fct_revenue, "demo_stg_orders_v2": demo_stg_orders_v2, "demo_status_pivot": demo_status_pivot, "demo_customers_joined": demo_customers_joined,
}
SQL = {
    "demo_orders_daily": _period_sql("day"), "demo_orders_weekly": _period_sql("week"), "demo_orders_monthly": _period_sql("month"),
    "demo_payment_analysis": f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_SUM.format('l_extendedprice')} AS amount FROM lineitem GROUP BY 1, 2",
    "demo_dim_customers": f"SELECT c_custkey, c_name, coalesce(n_orders, 0) AS n_orders, coalesce(total, 0.0e0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, {_SUM.format('o_totalprice')} AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) s ON s.o_custkey = c_custkey",
    "demo_fct_orders": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 0",
    "demo_fct_revenue": f"SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS month, count(*) AS n, {_SUM.format('l_extendedprice')} AS revenue FROM lineitem WHERE l_quantity > 10 GROUP BY 1",
    "demo_stg_orders_v2": "SELECT o_orderkey, upper(o_orderpriority) AS priority, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100, 0) AS BIGINT) AS cents FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000",
    "demo_status_pivot": "SELECT o_custkey, " + ", ".join(f"CAST(sum(CASE WHEN o_orderstatus = '{s}' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS total_{s.lower()}" for s in "FOP") + " FROM orders GROUP BY 1",
    "demo_customers_joined": "SELECT c_custkey, n_name, c_mktsegment FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
}
