"""Chat formatting: logged snapshots that longer ones begin with are collapsed, what is left is rendered.

A turn's hash depends on its position, role and text; the hash of a prefix is
the XOR of its turns' hashes (two of 64 bits each, and the number of turns), a
running value over the turns. A conversation whose whole hash is a proper
prefix hash of any other is dropped by an anti-join; of equal ones the smallest
id stays.

Running values are two-level: turns are cut into blocks by their number, so one
task only ever sorts a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkframe.llm.common import stage

#: Turn numbers in a block that one task sorts.
BLOCK = 4096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def _content(*more) -> Column:
    return F.xxhash64(*more, F.isnull("role"), F.coalesce("role", F.lit("")), F.isnull("text"), F.coalesce("text", F.lit("")))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), p1, p2: the hash of each prefix of each conversation.

    Turns are ordered by turn, role and text (nulls first); equal rows count once; rows without conv_id are no conversation.
    """
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("long").alias("block"), "turn", "role", F.col("text").alias("tie"), _content(F.lit(1)).alias("c1"), _content(F.lit(2)).alias("c2"))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "tie")
    rows = rows.withColumn("again", F.lag("c1").over(order).eqNullSafe(F.col("c1")) & F.lag("c2").over(order).eqNullSafe(F.col("c2")) & F.lag("turn").over(order).eqNullSafe(F.col("turn")))
    rows = rows.filter("not again").select("conv_id", "block", "c1", "c2", F.row_number().over(order).alias("at"))
    blocks = Window.partitionBy("conv_id").orderBy("block").rowsBetween(*_BEFORE)
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("k"))
    counts = counts.select("conv_id", "block", F.coalesce(F.sum("k").over(blocks), F.lit(0)).alias("ahead"))
    rows = rows.join(counts, ["conv_id", "block"]).withColumn("position", F.col("at") + F.col("ahead"))
    rows = rows.select("conv_id", "block", "position", *[F.xxhash64("position", c).alias(c) for c in ("c1", "c2")])
    totals = rows.groupBy("conv_id", "block").agg(*[F.bit_xor(c).alias(f"s_{c}") for c in ("c1", "c2")])
    totals = totals.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"s_{c}").over(blocks), F.lit(0)).alias(f"a_{c}") for c in ("c1", "c2")])
    inside = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(*_SO_FAR)
    rows = rows.select("conv_id", "block", "position", *[F.bit_xor(c).over(inside).alias(c) for c in ("c1", "c2")]).join(totals, ["conv_id", "block"])
    return rows.select("conv_id", "position", *[F.col(c).bitwiseXOR(F.col(f"a_{c}")).alias(p) for c, p in (("c1", "p1"), ("c2", "p2"))])


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_logged (equal conversations) of those that no longer conversation begins with."""
    prefixes = stage(prefix_hashes(turns), "chat-prefixes")
    n = prefixes.groupBy("conv_id").agg(F.max("position").alias("n"))
    marked = prefixes.join(n, "conv_id")
    whole = marked.filter("position = n").groupBy("position", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    proper = marked.filter("position < n").select("position", "p1", "p2").distinct()
    return whole.join(proper, ["position", "p1", "p2"], "left_anti").select("conv_id", F.col("position").cast("long").alias("n_turns"), "n_logged")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, text: each conversation's turns in the chat template; a null role is `user`, a null text is empty."""
    rows = turns.select("conv_id", F.struct("turn", "role", "text").alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_set("t"), _in_order).alias("ts"))
    each = F.transform("ts", lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("user")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE + "\n")))
    return rows.select("conv_id", F.array_join(each, "").alias("text"))


def _in_order(a: Column, b: Column) -> Column:
    """Comparator by turn, role, text, nulls first."""
    out = F.lit(0)
    for c in ("text", "role", "turn"):
        x, y = a[c], b[c]
        own = F.when(x.isNull() & y.isNull(), F.lit(None)).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1)
        out = F.coalesce(own, out)
    return out


def formatted(turns: DataFrame) -> DataFrame:
    """The maximal conversations, rendered: conv_id, n_turns, n_logged, text. No rows give no rows."""
    kept = stage(maximal(turns), "chat-kept")
    return render(turns.join(kept.select("conv_id"), "conv_id", "left_semi")).join(kept, "conv_id").select("conv_id", "n_turns", "n_logged", "text")


SQL = f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
whole AS (
  SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts,
    string_agg('{OPEN}' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '{CLOSE}' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM turns GROUP BY conv_id),
one AS (SELECT ts, min(conv_id) AS conv_id, count(*) AS n_logged, min(rendered) AS text FROM whole GROUP BY ts),
prefixes AS (SELECT DISTINCT list_slice(ts, 1, k) AS ts FROM (SELECT ts, unnest(range(1, len(ts))) AS k FROM whole))
SELECT conv_id, CAST(len(ts) AS BIGINT) AS n_turns, CAST(n_logged AS BIGINT) AS n_logged, text
FROM one WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.ts = one.ts)
"""
