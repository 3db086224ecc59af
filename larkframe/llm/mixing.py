"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated up to
`max_repeat` times. The virtual finish time of a document is the source's
cumulative words up to its end, divided by the source's target. Each unit of
virtual time then carries the words of all targets together, so the mix is
the global order by finish time, truncated where the total budget is spent:
at virtual time 1.

Truncation would leave a source short by what is left of its cut document. The
documents of the round that follow in finish order and still fit into that
remainder are admitted, all of them being looked at, so a source misses its
target by less than the smallest that was not admitted. The first `LOOKAHEAD`
are walked one by one; `_fill` does the rest in passes that halve the remainder.

Cumulative sums are two-level: a source is cut into blocks by shuffle key, the
sums of the blocks are added up, and only a block is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkframe.llm.common import apart, blocks_of, n_words, stage, together

CYCLE = (5, 2, 1)
MAX_REPEAT = 3
#: Documents after the cut that are walked one by one before the passes over the rest.
LOOKAHEAD = 256
#: Documents in a block that one task sorts.
BLOCK = 20_000


def source_targets(totals: DataFrame, cycle=CYCLE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Targets of the sources by water filling; `totals` has source, source_size.

    Weights repeat `cycle` over the sources by code point, null last. The
    shares of all sizes are capped at `max_repeat` times the source's size and
    the excess is dealt again by weight until none is above. The capped sources
    come first in the order of cap / weight, so one pass of running sums finds
    the level. Adds lane (from 1) and target.
    """
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    lanes = totals.select("source", "source_size", F.row_number().over(by_name).cast("long").alias("lane"))
    lanes = lanes.withColumn("w", F.element_at(weights, ((F.col("lane") - 1) % len(cycle) + 1).cast("int")))
    lanes = lanes.withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "lane")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    lanes = lanes.withColumn("level", level)
    lanes = lanes.withColumn("open", F.col("cap") > F.col("level") * F.col("w"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "lane", "level"))).over(everything)
    filled = F.least(F.col("cap"), first["level"] * F.col("w"))
    return lanes.select("lane", "source", "source_size", F.coalesce(filled, F.col("cap")).alias("target"))


def _shuffle_key(seed: int):
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), F.col("source")), 1)


def _fill(units: DataFrame, state: DataFrame) -> DataFrame:
    """Admits the units behind `at` that still fit, in queue order; `state` has lane, left and at.

    A pass takes the units of at most half of what is left by a running sum, up
    to the first unit that brings the remainder to a half or less: the one whose
    sum does, or the first larger one that fits when its turn comes. That is what
    walking the queue would take, and a remainder of n words needs log2(n) passes.
    Returns lane and spans: (at, half, until, last), by which units behind `at` up
    to `until` are admitted if they are at most `half` or end at `last`.
    """
    none = F.array().cast("array<struct<at:bigint,half:double,until:bigint,last:bigint>>")
    state = stage(state.select("lane", "left", "at", none.alias("spans"), F.lit(True).alias("open")), "mix-fill")
    half, small = F.col("left") / 2, F.when(F.col("unit") <= F.col("left") / 2, F.col("unit")).otherwise(0)
    ahead = Window.partitionBy("lane").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("lane", "block").orderBy("end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while not state.filter("open").isEmpty():
        behind = units.join(state.filter("open").select("lane", "left", "at"), "lane").filter((F.col("unit") > 0) & (F.col("end") > F.col("at")) & (F.col("unit") <= F.col("left")))
        behind = behind.select("lane", "block", "end", "unit", "left", small.alias("small"))
        sums = behind.groupBy("lane", "block").agg(F.sum("small").alias("sum"))
        sums = sums.select("lane", "block", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
        # Blocks that begin behind the half cannot hold the first such unit.
        near = behind.join(sums, ["lane", "block"]).filter(F.col("ahead") < half)
        near = near.withColumn("sum", F.col("ahead") + F.sum("small").over(within))
        stop = F.when(F.col("small") > 0, F.col("sum") >= half).otherwise(F.col("unit") <= F.col("left") - F.col("sum"))
        taken = F.col("sum") + F.col("unit") - F.col("small")
        stops = near.groupBy("lane").agg(F.min(F.when(stop, F.struct("end", taken.alias("taken")))).alias("stop"))
        last = F.col("stop")["end"]
        span = F.struct("at", half.alias("half"), F.coalesce(last, F.lit((1 << 63) - 1)).alias("until"), F.coalesce(last, F.lit(-1).cast("long")).alias("last"))
        state = state.join(stops.withColumn("seen", F.lit(True)), "lane", "left").select(
            "lane",
            F.coalesce(F.col("left") - F.col("stop")["taken"], F.col("left")).alias("left"),
            F.coalesce(last, F.col("at")).alias("at"),
            F.when(F.col("seen"), F.array_append("spans", span)).otherwise(F.col("spans")).alias("spans"),
            last.isNotNull().alias("open"),
        )
        state = stage(state, "mix-fill")
    return state.select("lane", "spans")


def fair_queue(docs: DataFrame, cycle=CYCLE, max_repeat: int = MAX_REPEAT, seed: int = 7) -> DataFrame:
    """Plans the mix: one row for each distinct (doc_id, text, source) of `docs`.

    Returns doc_id, key, source, lane, size (words of one such row), n_rows
    (equal rows, which are one unit of the queue), source_size, target, copies
    (times that the mix takes it, 0 to `max_repeat`) and start (words of its
    source before it). Reruns agree, whatever the partitions.

    Null texts and empty texts have size 0 and are never taken; a null source is
    a source. No rows give no rows.
    """
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _shuffle_key(seed).alias("key"))
    units = stage(slim.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("n_rows")).withColumn("unit", F.col("size") * F.col("n_rows")), "mix-units")
    targets = stage(source_targets(units.groupBy("source").agg(F.sum("unit").alias("source_size")), cycle, max_repeat), "mix-targets")
    n_blocks = blocks_of(units.count(), BLOCK)
    # The top 24 of the key's 63 bits, so that blocks are ranges of keys.
    block = F.floor(F.shiftrightunsigned("key", 39) * n_blocks / F.lit(1 << 24)).cast("long")
    units = units.join(targets, units["source"].eqNullSafe(targets["source"])).drop(targets["source"]).withColumn("block", block)
    sums = units.groupBy("lane", "block").agg(F.sum("unit").alias("sum"))
    ahead = Window.partitionBy("lane").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("lane", "block", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("lane", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = units.withColumn("within", F.sum("unit").over(within)).join(sums, ["lane", "block"])
    units = units.withColumn("end", F.col("ahead") + F.col("within")).drop("ahead", "within")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    units = units.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    units = stage(units, "mix-queue")

    # The first documents after the cut, a few per source: the limit is applied before the shuffle.
    rank = F.row_number().over(Window.partitionBy("lane").orderBy("end", "key"))
    next_up = units.filter((F.col("unit") > 0) & (F.col("end") > F.col("rest")) & (F.col("full") < max_repeat)).select("lane", "end", "key", "unit", "rest", "n_rows")
    next_up = next_up.withColumn("rank", rank).filter(F.col("rank") <= LOOKAHEAD)
    used = units.filter(F.col("end") <= F.col("rest")).groupBy("lane").agg(F.max("end").alias("used"))
    queue = next_up.groupBy("lane").agg(F.first("rest").alias("rest"), F.sort_array(F.collect_list(F.struct("end", "unit"))).alias("queue"))
    queue = queue.join(used, "lane", "left").withColumn("left", F.col("rest") - F.coalesce(F.col("used"), F.lit(0)))
    fits = F.aggregate(
        "queue",
        F.struct(F.col("left").alias("left"), F.array().cast("array<bigint>").alias("ends")),
        lambda a, x: F.when(x["unit"] <= a["left"], F.struct((a["left"] - x["unit"]).alias("left"), F.concat(a["ends"], F.array(x["end"])).alias("ends"))).otherwise(a),
    )
    queue = stage(queue.select("lane", fits.alias("fits"), F.element_at("queue", -1)["end"].alias("at")), "mix-walk")
    extra = queue.select("lane", F.explode("fits.ends").alias("end"), F.lit(1).alias("extra"))
    spans = _fill(units, queue.select("lane", "fits.left", "at"))
    units = units.join(extra, ["lane", "end"], "left").join(spans, "lane", "left")
    filled = F.exists("spans", lambda x: (F.col("end") > x["at"]) & (F.col("end") <= x["until"]) & ((F.col("unit") <= x["half"]) | (F.col("end") == x["last"])))
    extra = (F.col("extra").isNotNull() | F.coalesce(filled, F.lit(False))) & (F.col("unit") > 0)
    copies = F.col("full") + F.when((F.col("end") <= F.col("rest")) | extra, 1).otherwise(0)
    return units.select(
        "doc_id", "key", "source", "lane", "size", "n_rows", "source_size", "target",
        F.least(F.when(F.col("size") > 0, copies).otherwise(0), F.lit(max_repeat)).cast("int").alias("copies"),
        (F.col("end") - F.col("unit")).alias("start"),
    )


def finish_time(copy):
    """Virtual finish time of a unit's copy (0 for its first)."""
    end = copy * F.col("source_size") + F.col("start") + F.col("size") * F.col("n_rows")
    return F.when(F.col("target") > 0, F.least(end / F.col("target"), F.lit(1.0))).otherwise(1.0)


def by_finish(df: DataFrame, finish: str, tie: list[str]) -> DataFrame:
    """Global order by finish time: ranges of virtual time hold equal words, so no sample is needed to cut them. Rows without one come last in their task, spread by hash."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = F.least(F.floor(F.col(finish) * n), F.lit(n - 1))  # least() leaves nulls out, so a null has a branch of its own
    part = F.when(F.col(finish).isNull(), F.pmod(F.xxhash64(*tie), F.lit(n))).otherwise(ranges).cast("int")
    return df.repartitionById(n, part).sortWithinPartitions(F.col(finish).asc_nulls_last(), *tie)


def mix(docs: DataFrame, cycle=CYCLE, max_repeat: int = MAX_REPEAT, seed: int = 7) -> DataFrame:
    """The mixed documents with all their columns, whatever their names, a row per copy, in order of virtual finish time.

    Null and empty texts have no words and are left out; repeated rows are one unit
    and stay together; texts count whole, however long. Ties of finish time go by
    doc_id. No rows give no rows.
    """
    plan = fair_queue(docs, cycle, max_repeat, seed).filter("copies > 0")
    plan = plan.select(F.col("doc_id").alias("planned"), F.col("key").alias("at"), F.explode(F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda c: finish_time(c))).alias("finish"))
    rows = apart(docs, ["doc_id", "text", "source"]).select("doc_id", "whole", _shuffle_key(seed).alias("key"))
    mixed = rows.join(plan, rows["doc_id"].eqNullSafe(plan["planned"]) & (rows["key"] == plan["at"])).select("doc_id", "key", "finish", "whole")
    return together(by_finish(mixed, "finish", ["doc_id", "key"]), docs.columns)


def taken(docs: DataFrame, seed: int = 7) -> DataFrame:
    """What the mix takes of each row of `docs`: doc_id, size, source_size, target, taken, copies, finish (of the first copy; null if none is taken).

    One row per row, repeated ones too; null and empty texts have size 0 and are
    not taken. Other columns, whatever their names, take no part. No rows give no rows.
    """
    plan = fair_queue(docs, seed=seed).withColumn("finish", F.when(F.col("copies") > 0, finish_time(F.lit(0))))
    rows = plan.select("*", F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("row"))
    rows = by_finish(rows, "finish", ["doc_id", "key", "row"])
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "finish", "source")
