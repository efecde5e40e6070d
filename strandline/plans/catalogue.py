"""The registered queries: one for each operator, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import algebra, formats, graphs, repository, scalars  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES, query
from .tables import load


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


@query("""
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 10
""")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join, filter, group, order and take: the flagship query."""
    items = load(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    # revenue is first summed per customer key, so names join to one row a customer
    per = (
        items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
        .groupBy("o_custkey")
        .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    )
    return per.join(customers, per["o_custkey"] == customers["c_custkey"]).select("c_custkey", "c_name", "revenue").orderBy(F.desc("revenue"), "c_custkey").limit(10)
