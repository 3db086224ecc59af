"""Global, grouped and semi-join aggregates of one value column.

Each returns sum, count, min, max and avg by SQL's rules: nulls are left out, and
without values all but the count are null. All are partial aggregates, so only
one row per group and task is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _measures(value: str) -> list[Column]:
    v = F.col(value).cast("double")
    return [F.sum(v).alias("sum"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg")]


def global_agg(df: DataFrame, value: str) -> DataFrame:
    """One row: the aggregates of a column."""
    return df.agg(*_measures(value))


def group_agg(df: DataFrame, key: str, value: str, num_groups: int | None = None) -> DataFrame:
    """The aggregates per key. With `num_groups`, keys are 0 .. num_groups - 1 and groups without rows appear, others do not."""
    found = df.groupBy(key).agg(*_measures(value))
    if num_groups is None:
        return found
    every = df.sparkSession.range(num_groups).select(F.col("id").alias("_group"))
    out = every.join(found, every["_group"] == found[key], "left")
    return out.select(F.col("_group").alias(key), "sum", F.coalesce("count", F.lit(0)).alias("count"), "min", "max", "avg")


def semi_join_agg(build: DataFrame, build_key: str, probe: DataFrame, probe_key: str, value: str) -> DataFrame:
    """The aggregates of the probe rows whose key the build side has; repeated build keys count once."""
    keys = build.select(F.col(build_key).alias("_key"))
    return probe.join(keys, probe[probe_key] == keys["_key"], "left_semi").agg(*_measures(value))
