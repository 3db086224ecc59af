"""Seeded test data: orders and order_items of any size, made by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The states of an order.
STATUSES = ("pending", "shipped", "delivered", "cancelled")


def _uniform(seed: int, salt: int, *keys: str):
    """A number in [0, 1) that depends on the row's keys alone, so data are the same for any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys), F.lit(1 << 40)) / float(1 << 40)


def orders(spark: SparkSession, rows: int = 10_000, seed: int = 42) -> DataFrame:
    """id 0.., customer_id 1..999, amount [10, 1000), quantity 1..19, status."""
    return spark.range(rows).select(
        "id",
        (F.floor(_uniform(seed, 1, "id") * 999) + 1).cast("long").alias("customer_id"),
        (_uniform(seed, 2, "id") * 990 + 10).alias("amount"),
        (F.floor(_uniform(seed, 3, "id") * 19) + 1).cast("int").alias("quantity"),
        F.element_at(F.array(*map(F.lit, STATUSES)), (F.floor(_uniform(seed, 4, "id") * 4) + 1).cast("int")).alias("status"),
    )


def order_items(spark: SparkSession, rows: int = 10_000, seed: int = 42) -> DataFrame:
    """1 to 10 items for each of `rows` orders: id, order_id, product_id 1..9999, quantity 1..10, price [5, 500).

    An item's id is its order's id times 10 plus its place: unique and ascending
    with the order, without a global count.
    """
    items = spark.range(rows).select(F.col("id").alias("order_id"), F.explode(F.sequence(F.lit(0), F.floor(_uniform(seed, 5, "id") * 10).cast("int"))).alias("k"))
    return items.select(
        (F.col("order_id") * 10 + F.col("k")).alias("id"),
        "order_id",
        (F.floor(_uniform(seed, 6, "order_id", "k") * 9999) + 1).cast("long").alias("product_id"),
        (F.floor(_uniform(seed, 7, "order_id", "k") * 10) + 1).cast("int").alias("quantity"),
        (_uniform(seed, 8, "order_id", "k") * 495 + 5).alias("price"),
    )


def generate(spark: SparkSession, table: str, rows: int, output: str, seed: int = 42, files: int | None = None) -> None:
    """Writes a table as Parquet."""
    makers = {"orders": orders, "order_items": order_items}
    if table not in makers:
        raise ValueError(f"unknown table {table!r}; one of {', '.join(makers)}")
    df = makers[table](spark, rows, seed)
    (df.coalesce(files) if files else df).write.mode("overwrite").parquet(output)
