"""Best-fit packing into fixed-length sequences by the sum-of-squares rule.

Only the residual gap of an open sequence matters, so the packer keeps N[g],
the number of open sequences per gap g, and places a piece of length s where
the sum of N[g]^2 becomes smallest: moving one sequence from gap g to g - s
changes it by 2 (N[g-s] - N[g]) + 2, opening a new one by 2 N[B-s] + 1, filling
one exactly by 1 - 2 N[s].

When a group's pieces have all been placed, sequences that are still open are
dissolved and their pieces dealt again, longest first, into the smallest gap
that holds them. Pieces are placed in a shuffled order and longest first; the
best outcome stays.

Pieces are dealt to groups of about `GROUP`, so a group is packed in
one task and the waste is a few sequences per group at any size of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkframe.llm.common import blocks_of, in_slices, stage

LENGTH = 1024
END_ID = 2
#: Pieces that one task packs.
GROUP = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only the first may be shorter."""
    first = n % length or min(n, length)
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, tokenizers: str | None = None) -> DataFrame:
    """The pieces of every document's ids (null text: empty) followed by `end_id`."""
    last = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from larkframe.llm.tokens import byte_bpe

        bpe = byte_bpe(tokenizers)
        for batch in in_slices(batches, 1):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(text.as_py() or "") + last
                for k, (start, n) in enumerate(cut(len(ids) // 4, length)):
                    for column, x in zip(out, (doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, in the order given."""
    n = np.zeros(size + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    seq = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    made = 0
    never = np.int64(1) << 60
    for k, s in enumerate(lengths.tolist()):
        if s >= size:
            seq[k] = made
            made += 1
            continue
        change = 2 * (n[: size - s + 1] - n[s:]) + 2
        change[0] = 1 - 2 * n[s]
        change[n[s:] == 0] = never
        change[-1] = 2 * n[size - s] + 1
        after = int(change.argmin())
        gap = after + s
        if gap == size:
            at = made
            made += 1
        else:
            at = open_at[gap].pop()
            n[gap] -= 1
        seq[k], offset[k] = at, size - gap
        if after:
            open_at[after].append(at)
            n[after] += 1
    return seq, offset


def close_open(lengths: np.ndarray, seq: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Deals the pieces of sequences that are not full again, longest first into the smallest gap that holds them."""
    fill = np.bincount(seq, weights=lengths).astype(np.int64) if len(seq) else np.zeros(0, np.int64)
    full = fill == size
    again = np.flatnonzero(~full[seq])
    new = np.full(len(seq), -1, np.int64)
    kept = np.cumsum(full) - 1
    new[full[seq]] = kept[seq[full[seq]]]
    made = int(full.sum())
    gaps = np.zeros(size + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    for k in again[np.argsort(-lengths[again], kind="stable")].tolist():
        s = int(lengths[k])
        fits = np.flatnonzero(gaps[s:])
        if len(fits):
            gap = s + int(fits[0])
            gaps[gap] -= 1
            at = open_at[gap].pop()
        else:
            gap, at = size, made
            made += 1
        new[k] = at
        if gap > s:
            gaps[gap - s] += 1
            open_at[gap - s].append(at)
    order = np.lexsort((np.arange(len(new)), new))
    ends = np.cumsum(lengths[order])
    starts = ends - lengths[order]
    heads = np.r_[True, new[order][1:] != new[order][:-1]] if len(new) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(heads, starts, 0)) if len(new) else starts
    offset = np.zeros(len(new), np.int64)
    offset[order] = starts - base
    return new, offset


def place(lengths: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece: by sum of squares in the order given and longest first, the open sequences closed; the best outcome."""
    if not len(lengths):
        return lengths, lengths
    best = None
    for order in (np.arange(len(lengths)), np.argsort(-lengths, kind="stable")):
        plain = sum_of_squares(lengths[order], size)
        for seq, offset in (plain, close_open(lengths[order], plain[0], size)):
            if best is None or seq.max() < best[0].max():
                back = np.empty(len(order), np.int64)
                back[order] = np.arange(len(order))
                best = seq[back], offset[back]
    return best


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, tokenizers: str | None = None) -> DataFrame:
    """Packs all documents into sequences of at most `length` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, one
    row per piece. A null or empty text is the end id alone; rows that repeat
    a doc_id are packed each. Texts are encoded whole, however long; pieces of one
    length are equal to the packer. Other columns, whatever their names, take no
    part. No rows give no rows.
    """
    staged = stage(pieces(docs, length, end_id, tokenizers), "pack-pieces")
    groups = blocks_of(staged.count(), GROUP)
    # By place in the staged table, which does not change, so that repeated rows do not meet in one group.
    dealt = staged.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        n = t.column("length").to_numpy()
        # A fixed shuffle, so that what is placed together does not follow the ids.
        order = np.random.default_rng(len(n)).permutation(len(n))
        seq, offset = place(n[order], length)
        back = np.empty(len(n), np.int64)
        back[order] = np.arange(len(n))
        ids = seq[back] + (t.column("grp").to_numpy() << 32)
        return t.drop_columns(["grp"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset[back]))

    return dealt.groupBy("grp").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")
