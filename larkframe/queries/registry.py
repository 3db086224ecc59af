"""Queries by name: the SQL corpus, and the kernels on the test tables with their meaning in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkframe import functions
from larkframe import operators as K
from larkframe.queries.statements import STATEMENTS

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _statement(sql: str) -> Query:
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    named = any(re.search(rf"(?i)\b{name}\(", sql) for name in functions.FUNCTIONS)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if named:
            functions.register(spark)
        for t in used:
            _read(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    return run


def kernel_global_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.global_agg(_read(spark, sf_dir, "lineitem"), "l_quantity")


def kernel_group_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.group_agg(_read(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity")


def kernel_group_agg_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    largest = orders.agg(F.max("o_custkey")).first()[0]
    n = 0 if largest is None else largest + 1
    return K.group_agg(orders.filter("o_totalprice > 400000"), "o_custkey", "o_totalprice", num_groups=n).select("o_custkey", "count", "min", "max")


def kernel_semi_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = _read(spark, sf_dir, "lineitem").filter("l_quantity >= 40")
    probe = _read(spark, sf_dir, "orders").withColumn("units", F.col("o_custkey").cast("double"))
    return K.semi_join_agg(build, "l_orderkey", probe, "o_orderkey", "units")


def kernel_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.row_number(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ties=["o_orderkey"], descending=True)


def kernel_peer_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.peer_starts(_read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ties=["o_orderkey"])


def win_rank_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rank(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity"), "l_quantity", descending=True)


def kernel_dense_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dense_rank(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_partkey"), "l_partkey")


def kernel_dense_rank_from_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense rank as the running sum of peer starts."""
    peers = K.peer_starts(_read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ties=["o_orderkey"])
    return K.running_sum(peers, "peer_start", "o_custkey", ties=["o_orderkey"], name="dense_rank").select("o_custkey", "o_orderkey", "dense_rank")


def kernel_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity")
    return K.running_sum(df, "l_quantity", "l_orderkey", ties=["l_extendedprice"])


def win_running_sum_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("amount"))
    return K.running_sum(df, "amount", "o_orderkey").select("o_orderkey", F.col("running_sum").cast("double").alias("running_sum"))


def win_running_sum_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity")
    return K.running_sum(df, "l_quantity", "l_orderkey", peers=True)


def win_row_number_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.row_number(_read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", ties=["c_custkey"])


def win_row_number_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL leaves open how equal prices of a part are ordered; here they go by l_orderkey, so that reruns agree."""
    df = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_extendedprice")
    return K.row_number(df, "l_extendedprice", ["l_partkey"], ["l_orderkey"], descending=True, name="rn")


_MEASURES = "SUM({0}) AS sum, COUNT({0}) AS count, MIN({0}) AS min, MAX({0}) AS max, AVG({0}) AS avg"

#: Kernels: how they run, and what they mean in SQL.
KERNELS: dict[str, tuple[Query, str]] = {
    "kernel_global_agg": (kernel_global_agg, f"SELECT {_MEASURES.format('l_quantity')} FROM lineitem"),
    "kernel_group_agg": (kernel_group_agg, f"SELECT l_partkey, {_MEASURES.format('l_quantity')} FROM lineitem GROUP BY l_partkey"),
    "kernel_group_agg_dense": (kernel_group_agg_dense, "SELECT k AS o_custkey, COUNT(o_totalprice) AS count, MIN(o_totalprice) AS min, MAX(o_totalprice) AS max FROM (SELECT UNNEST(RANGE(0, (SELECT MAX(o_custkey) + 1 FROM orders))) AS k) LEFT JOIN orders ON o_custkey = k AND o_totalprice > 400000 GROUP BY k"),
    "kernel_semi_join_agg": (kernel_semi_join_agg, f"SELECT {_MEASURES.format('CAST(o_custkey AS DOUBLE)')} FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 40)"),
    "kernel_row_number": (kernel_row_number, "SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_number FROM orders"),
    "kernel_peer_starts": (kernel_peer_starts, "SELECT o_custkey, o_orderkey, CASE WHEN LAG(o_custkey) OVER (ORDER BY o_custkey, o_orderkey) = o_custkey THEN 0 ELSE 1 END AS peer_start FROM orders"),
    "kernel_dense_rank": (kernel_dense_rank, "SELECT l_orderkey, l_extendedprice, l_partkey, DENSE_RANK() OVER (ORDER BY l_partkey) AS dense_rank FROM lineitem"),
    "kernel_dense_rank_from_peers": (kernel_dense_rank_from_peers, "SELECT o_custkey, o_orderkey, DENSE_RANK() OVER (ORDER BY o_custkey) AS dense_rank FROM orders"),
    "kernel_running_sum": (kernel_running_sum, "SELECT l_orderkey, l_extendedprice, l_quantity, SUM(l_quantity) OVER (ORDER BY l_orderkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS running_sum FROM lineitem"),
    "win_rank_global": (win_rank_global, "SELECT l_orderkey, l_extendedprice, l_quantity, RANK() OVER (ORDER BY l_quantity DESC) AS rank FROM lineitem"),
    "win_row_number_global": (win_row_number_global, "SELECT c_custkey, c_name, ROW_NUMBER() OVER (ORDER BY c_name, c_custkey) AS row_number FROM customer"),
    "win_row_number_partition": (win_row_number_partition, "SELECT l_partkey, l_orderkey, l_extendedprice, CAST(ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC) AS BIGINT) AS rn FROM lineitem"),
    "win_running_sum_rows": (win_running_sum_rows, "SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_sum FROM orders"),
    "win_running_sum_range": (win_running_sum_range, "SELECT l_orderkey, l_extendedprice, l_quantity, SUM(l_quantity) OVER (ORDER BY l_orderkey) AS running_sum FROM lineitem"),
}


def queries() -> dict[str, Query]:
    return {name: _statement(sql) for name, (sql, _) in STATEMENTS.items()} | {name: run for name, (run, _) in KERNELS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle or sql for name, (sql, oracle) in STATEMENTS.items()} | {name: sql for name, (_, sql) in KERNELS.items()}
