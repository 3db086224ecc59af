"""Exact top-k inner products over a bit-sliced index.

Components are quantised to whole numbers. A block of rows is indexed by bit
slices: bitmap (d, j) holds bit j of component d (less the block's smallest) of
every row. The score of a query against all rows of the block is added up with
bitmap arithmetic: for each set bit i of the query's component d, the slices of d
enter a ripple-carry adder at levels i + j; a negative component takes the
complement slices instead, so all terms are positive and a constant remains.

The best k rows are selected from the most significant sum slice downward: a
set G of rows that are surely in and a set E of rows tied so far. What E holds in
the end are rows of equal score: the boundary is resolved by smaller id.

A block of queries is scored at once. Every block of rows meets every block of
queries once and leaves k rows per query; its index is made once for all the
query blocks that come to it together. Components are whole numbers in doubles, so
any finite vector takes part: where sums could pass 62 bits, a block is scored in
whole numbers without a bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkframe.llm.common import blocks_of, stage

SCALE = 256
#: Rows that one index block holds, and queries that are scored at once.
BLOCK, QUERY_BLOCK = 8192, 256
#: Query blocks that one task scores against a block of rows.
TOGETHER = 8
#: Rows with a component from here on are in blocks of their own, so that few rows go the wide way.
NARROW = 1 << 24
#: Bits that a sum may have; whole numbers beyond go the wide way.
BITS = 62
#: Scores are longs; what lies beyond is cut to their ends.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_BLOCKS = "dim int, block binary, ids binary, rows binary"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(256 x) of every component, whole numbers as doubles; vectors with null or non-finite components are left out, null ids too."""
    x = F.col(vector)
    # 256 x is exact in doubles, unless it overflows; then the component is beyond any whole number that can be told apart.
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c))
    rows = vectors.filter(x.isNotNull() & fine & F.col(id_col).isNotNull())
    largest = 1.7976931348623157e308
    scaled = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(largest)), F.lit(-largest))
    whole = lambda c: F.when(F.abs(scaled(c)) < 2.0**52, F.floor(scaled(c)).cast("double")).otherwise(scaled(c))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows as blocks of one dimension and kind (large or not) each, sorted by id; equal rows of a block count once."""

    def made(dim: int, rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        ids, v = np.concatenate([a for a, _ in rows]), np.concatenate([b for _, b in rows])
        for at in range(0, len(ids), size):
            order = np.lexsort([*v[at : at + size].T[::-1], ids[at : at + size]])
            i, x = ids[at : at + size][order], v[at : at + size][order]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (x[1:] != x[:-1]).any(1)
            own, mat = i[new].astype("<i8").tobytes(), (x[new] + 0.0).astype("<f8").tobytes()  # -0.0 is 0.0
            yield dim, hashlib.md5(own + mat).digest(), own, mat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        count: dict[tuple, int] = {}

        def out(keys):
            rows = [r for key in keys for r in made(key[0], held.pop(key))]
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["dim", "block", "ids", "rows"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            n = lists.value_lengths().to_numpy()
            flat, ends = lists.flatten().to_numpy(), np.cumsum(n)
            for d in np.unique(n).tolist():
                own = np.flatnonzero(n == d)
                v = flat[(ends[own] - d)[:, None] + np.arange(d)] if len(own) < len(n) else flat.reshape(-1, d)
                large = np.abs(v).max(1, initial=0) >= NARROW
                for side in np.unique(large).tolist():
                    key, at = (d, side), large == side
                    held.setdefault(key, []).append((ids[own[at]], v[at]))
                    count[key] = count.get(key, 0) + int(at.sum())
                    if count[key] >= size:
                        yield out([key])
                        count[key] = 0
        if held:
            yield out(sorted(held))

    return vectors.mapInArrow(run, _BLOCKS)


class BitSlices:
    """The index of a block of whole-number rows (n, dim)."""

    def __init__(self, rows: np.ndarray):
        self.n, self.dim = rows.shape
        self.low = rows.min(0) if self.n else np.zeros(self.dim, np.int64)
        v = rows - self.low
        self.bits = max(1, int(v.max(initial=0)).bit_length())
        words = max(1, -(-self.n // 64))
        self.slices = np.zeros((self.dim, self.bits, words), np.uint64)
        for j in range(self.bits):
            packed = np.packbits(((v >> j) & 1).astype(np.uint8).T, axis=1, bitorder="little")
            pad = np.zeros((self.dim, words * 8), np.uint8)
            pad[:, : packed.shape[1]] = packed
            self.slices[:, j] = pad.view(np.uint64)
        every = np.zeros(words * 8, np.uint8)
        every[: -(-self.n // 8)] = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        self.every = every.view(np.uint64)

    def add_up(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum slices (levels, queries, words) of all scores, and what to add to a query's sums."""
        top = (1 << self.bits) - 1
        size = np.abs(q)
        constant = q @ self.low - np.where(q < 0, size, 0).sum(1) * top
        levels = max(1, int(size.sum(1).max(initial=0) * top).bit_length())
        total = np.zeros((levels, len(q), self.every.size), np.uint64)
        carry, term, both = np.empty_like(total[0]), np.empty_like(total[0]), np.empty_like(total[0])
        ones = ~np.uint64(0)
        for d in range(self.dim):
            flip = np.where(q[:, d] < 0, ones, np.uint64(0))[:, None]
            for i in range(int(size[:, d].max(initial=0)).bit_length()):
                on = np.where((size[:, d] >> i) & 1, ones, np.uint64(0))[:, None]
                carry[:] = 0
                for level in range(i, levels):
                    at = total[level]
                    if level - i < self.bits:
                        np.bitwise_xor(self.slices[d, level - i], flip, out=term)
                        np.bitwise_and(term, on, out=term)
                        np.bitwise_xor(at, term, out=both)
                        np.bitwise_and(at, term, out=term)
                        np.bitwise_xor(both, carry, out=at)
                        np.bitwise_and(both, carry, out=carry)
                        np.bitwise_or(carry, term, out=carry)
                    elif carry.any():
                        np.bitwise_and(at, carry, out=term)
                        np.bitwise_xor(at, carry, out=at)
                        carry, term = term, carry
                    else:
                        break
        return total, constant

    def fits(self, q: np.ndarray) -> bool:
        """Whether all sums of these queries, and what is added to them, stay within BITS bits."""
        size = np.abs(q).max(0, initial=0).astype(object)
        return int((size * ((1 << self.bits) + np.abs(self.low).astype(object))).sum()) < 1 << BITS

    def best(self, q: np.ndarray, k: int, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the k best row numbers and their scores; own: bitmaps of rows that a query must not return."""
        total, constant = self.add_up(q)
        tied = self.every & ~own
        sure = np.zeros_like(tied)
        for at in total[::-1]:
            more = tied & at
            n = np.bitwise_count(sure | more).sum(1)[:, None]
            sure = np.where(n <= k, sure | more, sure)
            tied = np.where(n > k, more, np.where(n < k, tied & ~at, np.uint64(0)))
        for x in range(len(q)):
            rows = np.flatnonzero(np.unpackbits(sure[x].view(np.uint8), bitorder="little"))
            edge = np.flatnonzero(np.unpackbits(tied[x].view(np.uint8), bitorder="little"))[: k - len(rows)]
            rows = np.concatenate([rows, edge])
            bits = (total[:, x, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
            scores = (bits.astype(np.int64) << np.arange(len(total))[:, None]).sum(0) + constant[x]
            yield rows, scores


def wide(rows: np.ndarray, q: np.ndarray, k: int, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As BitSlices.best, in whole numbers without a bound; own (queries, rows): rows that a query must not return."""
    mat = np.array([[int(c) for c in r] for r in rows.tolist()], object)
    for x, query in enumerate(q.tolist()):
        scores = mat @ np.array([int(c) for c in query], object) if mat.size else np.zeros(len(rows), object)
        scores = [min(max(int(s), LEAST), MOST) for s in scores]
        at = sorted(np.flatnonzero(~own[x]).tolist(), key=lambda r: (-scores[r], r))[:k]
        yield np.array(at, np.int64), np.array([scores[r] for r in at], np.int64)


def _scores(rows: pa.Table, asks: pa.Table, k: int) -> pa.Table:
    """The k best of a block of rows for each query of some blocks of queries."""
    found: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    blobs = [asks.column(c).to_pylist() for c in ("q_ids", "q_rows")]
    for dim, ids, mat in zip(*[rows.column(c).to_pylist() for c in ("dim", "ids", "rows")], strict=True):
        ids = np.frombuffer(ids, "<i8")
        mat = np.frombuffer(mat, "<f8").reshape(len(ids), dim)
        index = BitSlices(mat.astype(np.int64)) if np.abs(mat).max(initial=0) < 1 << 31 else None
        for q_ids, q in zip(*blobs, strict=True):
            q_ids = np.frombuffer(q_ids, "<i8")
            q = np.frombuffer(q, "<f8").reshape(len(q_ids), dim)
            same = q_ids[:, None] == ids[None, :]
            if index is not None and np.abs(q).max(initial=0) < 1 << 31 and index.fits(q.astype(np.int64)):
                own = np.zeros((len(q_ids), index.every.size * 64), np.uint8)
                own[:, : len(ids)] = same
                out = list(index.best(q.astype(np.int64), k, np.packbits(own, axis=1, bitorder="little").view(np.uint64)))
            else:
                out = list(wide(mat, q, k, same))
            found[0] += [np.full(len(r), a, np.int64) for a, (r, _) in zip(q_ids, out, strict=True)]
            found[1] += [ids[r] for r, _ in out]
            found[2] += [s for _, s in out]
    return pa.table([pa.array(np.concatenate(x)) for x in found], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """For each query of (vec_id, v) its k best rows of (vec_id, v): query_id, rank, vec_id, score.

    A row with the query's own id is not its candidate; ties go to the smaller
    id; equal rows count once; vectors meet only vectors of their own length, and
    empty ones score 0. Scores beyond a long are cut to its ends, and ties there. No queries or no
    candidates give no rows.
    """
    # Blocks are staged, so that they are the same whenever a task is run again.
    rows = stage(_blocks(vectors, BLOCK), "topk-rows")
    asks = stage(_blocks(queries.coalesce(max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)), QUERY_BLOCK), "topk-queries")
    # Blocks of a dimension get dense numbers: one slim row per block is ordered in one place.
    slots = rows.select("dim", "block").distinct().select("dim", "block", (F.row_number().over(Window.partitionBy("dim").orderBy("block")) - 1).alias("slot"))
    slots = stage(slots, "topk-slots")
    parts = blocks_of(asks.count(), TOGETHER)
    n = slots.groupBy("dim").agg(F.count("*").cast("int").alias("n")).select(F.col("dim").alias("d"), "n")
    asks = asks.dropDuplicates(["dim", "block"]).join(n, F.col("dim") == F.col("d"))
    asks = asks.select("dim", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"), F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    rows = rows.dropDuplicates(["dim", "block"]).join(slots, ["dim", "block"]).select("dim", "slot", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "ids", "rows")
    by = ["dim", "slot", "part"]
    near = rows.groupBy(*by).cogroup(asks.groupBy(*by)).applyInArrow(lambda r, a: _scores(r, a, k), "query_id long, vec_id long, score long").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The registered query in SQL: every query against every row, as whole-number inner products.
SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
