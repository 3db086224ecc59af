"""Row numbers, peers, ranks and running sums, over a partition or over the whole table.

Over the whole table a window without partition would sort all rows in one task.

What peers share (ranks, dense ranks, sums up to the last peer) needs no order of
rows: rows are summed up by key, the distinct keys are scanned, and the result is
joined back. A key that holds most rows is one row of the scan.

What rows have of their own (row numbers, sums up to the row) comes from ranges:
rows are cut into ranges of the order, each range is scanned by itself, and what
the ranges before it hold is added. Bounds are quantiles of the key and ranges
between two of them are cut evenly, so their number grows with the rows; a key that
holds several quantiles, or null, is cut by quantiles of the first tie. Only the
sums of the ranges are ever in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quantiles of the key that bound ranges, at most; and of the first tie within a key that holds many rows.
BOUNDS, TIE_BOUNDS = 512, 64
#: Rows that a range holds about.
PER_RANGE = 100_000
#: Above all numbers of ranges: nulls come last.
_LAST = 1 << 61
_EXACT = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _sorted(key: str, descending: bool) -> Column:
    return F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()


def _fractions(n: int) -> Column:
    """0, 1/n .. 1 as one constant."""
    return F.expr(f"array({', '.join(f'{k / n!r}D' for k in range(n + 1))})")


def _constants(values: list, kind: str) -> Column:
    return F.expr(f"array({', '.join(f"CAST('{v!r}' AS {kind})" for v in values)})")


def _at_most(edges: Column, size: int, x: Column) -> Column:
    """How many of the ordered edges are at most x, in two steps of about the root of their number."""
    step = max(1, int(size**0.5))
    coarse = F.slice(F.transform(F.sequence(F.lit(0), F.lit(max(0, (size - 1) // step))), lambda k: F.element_at(edges, k * step + 1)), 1, size)
    at = F.greatest(F.size(F.filter(coarse, lambda b: b <= x)) - 1, F.lit(0)) * step
    return at + F.size(F.filter(F.slice(edges, at + 1, step), lambda b: b <= x))


def _evenly(x: Column, low: Column, high: Column, parts: Column) -> Column:
    """Which of the parts between low and high x is in."""
    share = (x.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double"))
    return F.when(high > low, F.greatest(F.least(F.floor(share * parts), parts - 1), F.lit(0))).otherwise(0)


def _ranged(df: DataFrame, key: str, descending: bool, ranges: int | None, tie: str | None = None) -> DataFrame:
    """Adds _range, a number that grows in the order of (key, tie); nulls last. Equal keys are in one unless they are cut by the tie."""
    kinds = dict(df.dtypes)
    if kinds[key] not in _EXACT:
        return _ranged_by_keys(df, key, descending, ranges)
    if tie is not None and kinds[tie] not in _EXACT:
        tie = None
    most = ranges or BOUNDS
    found, n, nulls = df.agg(F.percentile_approx(key, _fractions(most), F.lit(20 * most)), F.count("*"), F.count_if(F.col(key).isNull())).first()
    found = sorted(found) if found else [0]
    use = min(most, max(2, -(-n // PER_RANGE))) if ranges is None else ranges
    found = [found[-(-k * (len(found) - 1) // use)] for k in range(use + 1)]
    parts = 1 if ranges else max(1, -(-n // (PER_RANGE * use)))
    bounds = sorted(set(found))
    edges, x = _constants(bounds, kinds[key]), F.col(key)
    at = F.greatest(_at_most(edges, len(bounds), x), F.lit(1))
    low, high = F.element_at(edges, at), F.element_at(edges, F.least(at + 1, F.lit(len(bounds))))
    inside = _evenly(x, low, high, F.lit(parts))
    hot = {b: found.count(b) - 1 for b in bounds if found.count(b) > 1} if tie else {}
    of_null = -(-nulls // PER_RANGE) if ranges is None else ranges
    width = max([parts, *[parts * (m + 1) for m in hot.values()], of_null]) + TIE_BOUNDS
    sign = -1 if descending else 1
    inside = parts - 1 - inside if descending else inside
    if not hot and not (tie and nulls > PER_RANGE):
        return df.withColumn("_range", F.when(x.isNotNull(), (sign * 2 * at) * F.lit(width).cast("long") + inside).otherwise(_LAST))
    # Quantiles of the tie in each hot key: at most BOUNDS + 1 rows, broadcast.
    some = df.filter(x.isin(list(hot)) | x.isNull()) if hot else df.filter(x.isNull())
    found = some.groupBy(key).agg(F.percentile_approx(tie, _fractions(TIE_BOUNDS), F.lit(20 * TIE_BOUNDS)).alias("_edges"))
    want = F.when(F.col(key).isNull(), F.lit(of_null))
    for b, m in hot.items():
        want = want.when(x == F.lit(b), F.lit(parts * (m + 1)))
    found = found.select(F.col(key).alias("_hot"), F.array_sort("_edges").alias("_edges"), want.alias("_want"))
    df = df.join(F.broadcast(found), x.eqNullSafe(F.col("_hot")), "left")
    t = F.col(tie)
    place = F.greatest(F.size(F.filter("_edges", lambda b: b <= t)), F.lit(1))
    each = F.ceil(F.col("_want") / TIE_BOUNDS)
    within = _evenly(t, F.element_at("_edges", place), F.element_at("_edges", F.least(place + 1, F.size("_edges"))), each)
    # Ties order nulls first, and so do their ranges.
    sub = F.when(t.isNull() | F.col("_edges").isNull(), 0).otherwise((place - 1) * each + within)
    is_hot = F.col("_want").isNotNull() & x.isNotNull()
    number = F.when(x.isNull(), F.lit(_LAST) + sub).when(is_hot, (sign * (2 * at - 1)) * F.lit(width).cast("long") + sub).otherwise((sign * 2 * at) * F.lit(width).cast("long") + inside)
    return df.withColumn("_range", number).drop("_hot", "_edges", "_want")


def _ranged_by_keys(df: DataFrame, key: str, descending: bool, ranges: int | None) -> DataFrame:
    """For keys without quantiles: Spark's own range partitioning of the distinct keys gives the bounds."""
    ranges = ranges or max(2, min(BOUNDS, -(-df.count() // PER_RANGE)))
    keys = df.select(key).distinct().repartitionByRange(ranges, _sorted(key, descending)).select(F.col(key).alias("_key"), F.spark_partition_id().alias("_range"))
    bounds = keys.groupBy("_range").agg(F.min("_key").alias("low"), F.max("_key").alias("high")).filter("low is not null").collect()
    edges = sorted(((r.high if not descending else r.low) for r in bounds), reverse=descending)[:-1]
    tests = [(F.col(key) > F.lit(e)) if not descending else (F.col(key) < F.lit(e)) for e in edges]
    at = sum((F.when(t, 1).otherwise(0) for t in tests), F.lit(0))
    return df.withColumn("_range", F.when(F.col(key).isNotNull(), at).otherwise(_LAST))


def _ahead(df: DataFrame, *measures: Column) -> DataFrame:
    """Adds _ahead0, _ahead1 ..: the measures summed over the ranges before a row's own. One row per range is in one place."""
    sums = df.groupBy("_range").agg(*[m.alias(f"_sum{k}") for k, m in enumerate(measures)])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", *[F.sum(f"_sum{k}").over(before).alias(f"_ahead{k}") for k in range(len(measures))])
    return df.join(sums, "_range")


def _plus(a: Column, b: Column) -> Column:
    """Sum of what is not null; null if neither is."""
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def _by_key(df: DataFrame, key: str, descending: bool, ranges: int | None, value: str | None = None) -> DataFrame:
    """Adds _before (rows of the keys before), _dense (keys up to the row's own) and, with a value, _total (its sum up to the last peer)."""
    keys = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), (F.sum(value) if value else F.lit(0)).alias("_s"))
    keys = _ranged(keys, "_key", descending, ranges)
    order = Window.partitionBy("_range").orderBy(_sorted("_key", descending))
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = _ahead(keys.select("*", F.sum("_n").over(before).alias("_b"), F.row_number().over(order).alias("_d"), F.sum("_s").over(so_far).alias("_t")), F.sum("_n"), F.count("*"), F.sum("_s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    scanned = scanned.select("_key", (zero("_b") + zero("_ahead0")).alias("_before"), (F.col("_d") + zero("_ahead1")).alias("_dense"), _plus(F.col("_t"), F.col("_ahead2")).alias("_total"))
    return df.join(scanned, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def row_number(df: DataFrame, order: str, partition: list[str] | None = None, ties: list[str] | None = None, descending: bool = False, name: str = "row_number", ranges: int | None = None) -> DataFrame:
    """Adds the row number by `order`, then `ties`, as a long from 1; nulls of the order last."""
    if not partition:
        df = _ranged(df, order, descending, ranges, ties[0] if ties else None)
    w = Window.partitionBy(*(partition or ["_range"])).orderBy(_sorted(order, descending), *(ties or []))
    out = df.withColumn(name, F.row_number().over(w).cast("long"))
    if not partition:
        out = _ahead(out, F.count("*")).withColumn(name, F.col(name) + F.coalesce("_ahead0", F.lit(0))).drop("_ahead0", "_range")
    return out


def peer_starts(df: DataFrame, order: str, partition: list[str] | None = None, ties: list[str] | None = None, name: str = "peer_start", ranges: int | None = None) -> DataFrame:
    """Adds 1 to the first row of each run of equal keys and 0 to the others; nulls are peers and come last."""
    if not partition:
        numbered = _by_key(row_number(df, order, ties=ties, name="_row", ranges=ranges), order, False, ranges)
        return numbered.withColumn(name, (F.col("_row") == F.col("_before") + 1).cast("int")).drop("_row", "_before", "_dense", "_total")
    w = Window.partitionBy(*partition).orderBy(_sorted(order, False), *(ties or []))
    start = F.when((F.row_number().over(w) > 1) & F.lag(order).over(w).eqNullSafe(F.col(order)), 0).otherwise(1)
    return df.withColumn(name, start.cast("int"))


def rank(df: DataFrame, order: str, partition: list[str] | None = None, descending: bool = False, name: str = "rank", ranges: int | None = None) -> DataFrame:
    """Adds the rank: the row number of the first peer."""
    if partition:
        return df.withColumn(name, F.rank().over(Window.partitionBy(*partition).orderBy(_sorted(order, descending))).cast("long"))
    return _by_key(df, order, descending, ranges).withColumn(name, (F.col("_before") + 1).cast("long")).drop("_before", "_dense", "_total")


def dense_rank(df: DataFrame, order: str, partition: list[str] | None = None, descending: bool = False, name: str = "dense_rank", ranges: int | None = None) -> DataFrame:
    """Adds the dense rank: the number of peer groups up to the row's own."""
    if partition:
        return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*partition).orderBy(_sorted(order, descending))).cast("long"))
    return _by_key(df, order, descending, ranges).withColumn(name, F.col("_dense").cast("long")).drop("_before", "_dense", "_total")


def running_sum(df: DataFrame, value: str, order: str, partition: list[str] | None = None, ties: list[str] | None = None, peers: bool = False, name: str = "running_sum", ranges: int | None = None) -> DataFrame:
    """Adds the sum up to the row, or up to its last peer with `peers`; null until a first value."""
    if partition:
        w = Window.partitionBy(*partition).orderBy(_sorted(order, False), *([] if peers else ties or []))
        return df.withColumn(name, F.sum(value).over(w.rangeBetween(Window.unboundedPreceding, 0) if peers else w.rowsBetween(Window.unboundedPreceding, 0)))
    if peers:
        return _by_key(df, order, False, ranges, value).withColumn(name, F.col("_total")).drop("_before", "_dense", "_total")
    df = _ranged(df, order, False, ranges, ties[0] if ties else None)
    w = Window.partitionBy("_range").orderBy(_sorted(order, False), *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    out = _ahead(df.withColumn(name, F.sum(value).over(w)), F.sum(value))
    return out.withColumn(name, _plus(F.col(name), F.col("_ahead0"))).drop("_ahead0", "_range")
