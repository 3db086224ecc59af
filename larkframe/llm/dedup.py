"""Near-duplicate classes by consistent weighted sampling over TF-IDF word shingles.

1. Equal texts collapse: a text is known by its 64-bit hash, one row stands for it.
2. A shingle is five words (a shorter text is one shingle), its weight is
   (1 + ln tf) * idf. The document frequencies come from two rows of hashed
   counters of a fixed size: idf only distinguishes shares of the corpus above
   `RARE`, and a counter's noise is a share of the corpus too, so the size need
   not grow. idf runs from 1 (in every text) to 1 + `SPREAD` (rare).
3. Improved consistent weighted sampling: for each of BANDS x ROWS draws an
   element k gets r, c ~ Gamma(2, 1), b ~ U(0, 1) from its hash; with
   t = floor(ln w / r + b), ln y = r (t - b), the sample is the (k, t) with the
   least ln c - ln y - r. Two texts draw the same sample with a probability
   equal to their weighted Jaccard similarity. Rows of samples form bands.
4. Texts of a band bucket are compared with the bucket's centre (the text whose
   buckets are the largest), exactly, by weighted Jaccard similarity. All the
   texts that share a centre form its star.
5. Links that a star's centre has not shown can only be between texts of different
   classes, and one of the two is outside its centre's class. Every member is known
   by its difference from the centre (shingle and change of weight), and two
   members' distance is what both differ by, less twice what they share of it. What
   nobody else in the star shares bounds that from a member alone, which leaves out
   most; the rest meet in tiles of bounded size: matrix products bound all pairs of
   a tile, exact sums decide those that may be similar, best first, and a pair whose
   classes the tile has united already is not looked at. A tile only tells links of
   a spanning forest, so rows grow with texts and not with pairs. No pair of a
   bucket is lost.
6. Connected components of the links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkframe.llm.common import apart, in_slices, stage, together
from larkframe.llm.words import mixed, word_hashes

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 9, 3
#: Counters in a row of the frequency table; a share of texts up to which shingles count as rare; how much idf adds.
COUNTERS, RARE, SPREAD = 1 << 18, 1 / 64, 0.25
#: Pieces that the counters are added up in, and tasks that count (each leaves one table of counters).
PARTS, COUNTING = 64, 2048
#: Slots of the precomputed draws, steps of idf.
SLOTS, IDF_STEPS = 1 << 16, 8
_MULTIPLY = [np.uint64(k | 1) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_TINY = 1e-9
#: Members of a star, and changed shingles, that one side of a tile holds about.
TILE, TILE_CHANGES = 512, 1 << 20
#: Columns that a tile's matrix products take at a time.
COLUMNS = 8192


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, tf) of the distinct shingles of each text, sorted by text and hash."""
    hashes, counts = word_hashes(texts)
    starts = np.cumsum(counts) - counts
    per_text = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), per_text)
    if not len(text):
        return text, np.zeros(0, np.uint64), text
    at = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + starts[text]
    whole = (counts >= words)[text]
    own = np.zeros(len(text), np.uint64)
    for k in range(words):
        word = hashes[np.minimum(at + k, len(hashes) - 1)]
        own += (word if whole.all() else np.where(whole | (k < counts[text]), word, np.uint64(k + 1))) * _MULTIPLY[k % 5] + np.uint64(k)
        own ^= own >> np.uint64(29)
    own = mixed(own)
    # 40 bits of hash behind the number of the text: one sort of whole numbers.
    key = (text.astype(np.uint64) << np.uint64(40)) | (own >> np.uint64(24))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(first, len(key)))
    return (key[first] >> np.uint64(40)).astype(np.int64), key[first] & np.uint64((1 << 40) - 1), tf


def _cells(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two counters of each shingle."""
    h = mixed(hashes)
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def idf_steps(texts: DataFrame) -> np.ndarray:
    """For each pair of counters' cells the step of idf, 0 (in every text) to IDF_STEPS - 1 (rare): (2, COUNTERS) bytes.

    The counters of all tasks meet in PARTS pieces; what reaches the driver has a fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((2, COUNTERS), np.int64)
        n = s = 0
        for batch in in_slices(batches, 0):
            _, hashes, _ = shingles(batch.column(0))
            for row, own in zip(cells, _cells(hashes), strict=True):
                row += np.bincount(own, minlength=COUNTERS)
            n, s = n + batch.num_rows, s + len(hashes)
        pieces = cells.astype("<u4").reshape(PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary()), pa.array([n] * len(pieces), pa.int64()), pa.array([s] * len(pieces), pa.int64())], ["piece", "cells", "n", "s"])

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        total = np.zeros(2 * COUNTERS // PARTS, np.int64)
        for b in t.column("cells").to_pylist():
            total += np.frombuffer(b, "<u4")
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([total.astype("<i8").tobytes()], pa.binary()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "s": pa.array([sum(t.column("s").to_pylist())], pa.int64())})

    kind = "piece int, cells binary, n long, s long"
    rows = texts.select("text").coalesce(COUNTING).mapInArrow(count, kind).groupBy("piece").applyInArrow(add, kind).collect()
    if not rows:
        return np.full((2, COUNTERS), IDF_STEPS - 1, np.uint8)
    cells = np.concatenate([np.frombuffer(r.cells, "<i8") for r in sorted(rows, key=lambda r: r.piece)]).reshape(2, COUNTERS)
    n, s = rows[0].n, rows[0].s
    # What other shingles add to a counter on average is taken off.
    share = np.clip((cells - s / COUNTERS) / max(n, 1), 0, 1)
    rarity = np.log(np.maximum(share, RARE)) / np.log(RARE)
    return np.rint(rarity * (IDF_STEPS - 1)).astype(np.uint8)


def rareness(hashes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Step of idf of each shingle; it is as rare as the rarer of its counters says."""
    a, b = _cells(hashes)
    return np.maximum(steps[0][a], steps[1][b])


def weights(rare: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """TF-IDF weights."""
    return (1 + np.log(tf)) * (1 + SPREAD * rare / (IDF_STEPS - 1))


_DRAWS: list = []


def _ordered(a: np.ndarray) -> np.ndarray:
    """Bits of a 32-bit float in an order that agrees with its value."""
    bits = a.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def _log_a(lnw: np.ndarray, r: np.ndarray, lnc: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln a = ln c - ln y - r of the sampling, where ln y = r (floor(ln w / r + b) - b)."""
    return lnc - r * (np.floor(lnw / r + b) - b) - r


def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c, b (draws, SLOTS), the same everywhere, and ln a of each idf step at tf 1 as ordered bits (draws, IDF_STEPS * SLOTS)."""
    if not _DRAWS:
        n = BANDS * ROWS
        g = np.random.Generator(np.random.PCG64(20_011))
        r = np.maximum(g.gamma(2.0, 1.0, (n, SLOTS)), 1e-6)
        lnc, b = np.log(g.gamma(2.0, 1.0, (n, SLOTS))), g.random((n, SLOTS))
        lnw = np.log(weights(np.arange(IDF_STEPS), np.ones(IDF_STEPS)))
        table = np.stack([_ordered(_log_a(lnw[:, None], r[k], lnc[k], b[k])).ravel() for k in range(n)])
        _DRAWS.append((r, lnc, b, table))
    return _DRAWS[0]


def bands(text: np.ndarray, hashes: np.ndarray, tf: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have shingles, their band hashes (texts, BANDS))."""
    if not len(text):
        return text, np.zeros((0, BANDS), np.int64)
    r, lnc, b, table = draws()
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    many = np.flatnonzero(tf > 1)
    lnw = np.log(weights(rare[many], tf[many]))
    plane = rare.astype(np.uint64) * np.uint64(SLOTS)
    spread = mixed(hashes)
    low = spread >> np.uint64(32)
    out = np.zeros((len(first), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        slot = (spread * np.uint64((0xD1B54A32D192ED03 * (2 * k + 1)) & ((1 << 64) - 1))) >> np.uint64(48)
        a = table[k][slot + plane].astype(np.uint64)
        if len(many):
            own = slot[many]
            a[many] = _ordered(_log_a(lnw, r[k][own], lnc[k][own], b[k][own]))
        # The element's hash follows ln a: one minimum picks the sample.
        a <<= np.uint64(32)
        a |= low
        out[:, k // ROWS] = mixed(out[:, k // ROWS] ^ np.minimum.reduceat(a, first))
    return text[first], (out + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted hashes, weights)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    shared = np.minimum(a[1][both], b[1][at[both]]).sum()
    union = a[1].sum() + b[1].sum() - shared
    return float(shared / union) if union > 0 else 0.0


def _vectors(texts: pa.Array, steps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    text, hashes, tf = shingles(texts)
    w = weights(rareness(hashes, steps), tf)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    return [(hashes[i:j], w[i:j]) for i, j in zip(cut, cut[1:], strict=False)]


def signed(texts: DataFrame, shared) -> DataFrame:
    """doc, bands of each text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            text, hashes, tf = shingles(batch.column(1))
            rows, own = bands(text, hashes, tf, rareness(hashes, shared.value))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, BANDS), pa.int32()), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], ["doc", "bands"])

    return texts.select("doc", "text").mapInArrow(run, "doc long, bands array<long>")


_COMPARED = "a long, b long, similar double, a_weight double, weight double, keys array<long>, changes array<double>"


def changed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (a shingle and whether its weight grew) and how much the weights of b differ from those of a."""
    keys = np.union1d(a[0], b[0])
    change = np.zeros(len(keys))
    change[np.searchsorted(keys, b[0])] = b[1]
    change[np.searchsorted(keys, a[0])] -= a[1]
    own = np.flatnonzero(np.abs(change) > _TINY)
    return (keys[own].astype(np.int64) << 1) | (change[own] > 0), np.abs(change[own])


def _compared(pairs: DataFrame, shared) -> DataFrame:
    """Similarity of (a, ta), (b, tb), the weights of both and what b changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in in_slices(batches, 3):
            sims, own, keys, changes = [], [], [], []
            for a, ta, vb in zip(batch.column(0).to_pylist(), batch.column(1), _vectors(batch.column(3), shared.value), strict=True):
                if held[0] != a:  # rows of one a follow each other
                    held = (a, _vectors(pa.array([ta.as_py()], pa.string()), shared.value)[0])
                sims.append(similarity(held[1], vb))
                own.append((float(held[1][1].sum()), float(vb[1].sum())))
                for column, x in zip((keys, changes), changed(held[1], vb), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sims, pa.float64()), pa.array([x for x, _ in own], pa.float64()), pa.array([x for _, x in own], pa.float64()), pa.array(keys, pa.list_(pa.int64())), pa.array(changes, pa.list_(pa.float64()))],
                ["a", "b", "similar", "a_weight", "weight", "keys", "changes"],
            )

    return pairs.select("a", "ta", "b", "tb").mapInArrow(run, _COMPARED)


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds the texts of pairs (a, b), the rows of one a together."""
    b = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
    return b.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").sortWithinPartitions("a")


def stars(rows: DataFrame) -> DataFrame:
    """(a, b): each text b of a bucket with the bucket's centre a; rows: doc, band, h."""
    sizes = rows.groupBy("band", "h").agg(F.count("*").alias("n")).filter("n > 1")
    rows = stage(rows.join(sizes, ["band", "h"]), "dedup-buckets")
    central = rows.groupBy("doc").agg(F.sum(F.log2("n")).alias("central"))
    ranked = rows.join(central, "doc").select("band", "h", "doc", "central")
    heads = ranked.groupBy("band", "h").agg(F.max(F.struct("central", "doc")).alias("head")).select("band", "h", F.col("head.doc").alias("a"))
    return rows.join(heads, ["band", "h"]).select("a", F.col("doc").alias("b")).filter("a != b").distinct()


class _Sets:
    """Classes that grow together."""

    def __init__(self):
        self.up: dict = {}

    def of(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def joined(self, x, y) -> bool:
        """Unites two classes; False if they were one."""
        x, y = self.of(x), self.of(y)
        self.up[x] = y
        return x != y


def tile_links(x: dict, y: dict, similar: float) -> list[tuple[int, int]]:
    """Links (row of x, row of y) between texts of different classes: a spanning forest of all that are `similar`.

    x, y: weight, d (distance from the centre), class (lists), keys and changes (per row, sorted by key).
    """
    k = (1 - similar) / (1 + similar)
    columns = np.intersect1d(*[np.concatenate(s["keys"]) for s in (x, y)])
    bound = np.zeros((len(x["d"]), len(y["d"])), np.float32)
    for at in range(0, len(columns), COLUMNS):
        part = columns[at : at + COLUMNS]
        dense = []
        for s in (x, y):
            m = np.zeros((len(s["d"]), len(part)), np.float32)
            for r, (own, change) in enumerate(zip(s["keys"], s["changes"], strict=True)):
                lo, hi = np.searchsorted(own, [part[0], part[-1] + 1])
                where = np.searchsorted(part, own[lo:hi])
                hit = part[where] == own[lo:hi]
                m[r, where[hit]] = np.sqrt(change[lo:hi][hit])  # min(u, v) <= sqrt(u) sqrt(v)
            dense.append(m)
        bound += dense[0] @ dense[1].T
    far = [np.asarray(s["d"]) - k * np.asarray(s["weight"]) for s in (x, y)]
    # The distance d(x) + d(y) - 2 shared is at most k (|x| + |y|) for similar texts.
    slack = 2 * bound * (1 + 1e-4) - far[0][:, None] - far[1][None, :]
    names = {c: i for i, c in enumerate(sorted({*x["class"], *y["class"]}))}
    cx, cy = (np.array([names[c] for c in s["class"]]) for s in (x, y))
    rows, cols = np.nonzero((slack >= -1e-6) & (cx[:, None] != cy[None, :]))
    best = np.argsort(-slack[rows, cols], kind="stable")
    sets, found = _Sets(), []
    for r, c in zip(rows[best].tolist(), cols[best].tolist(), strict=True):
        if sets.of(int(cx[r])) == sets.of(int(cy[c])):
            continue
        _, i, j = np.intersect1d(x["keys"][r], y["keys"][c], assume_unique=True, return_indices=True)
        apart_ = x["d"][r] + y["d"][c] - 2 * np.minimum(x["changes"][r][i], y["changes"][c][j]).sum()
        both = x["weight"][r] + y["weight"][c]
        if both - apart_ >= similar * (both + apart_) - _TINY * both:
            sets.joined(int(cx[r]), int(cy[c]))
            found.append((r, c))
    return found


def _tile(t: pa.Table, similar: float) -> pa.Table:
    keep = t.column("side").to_numpy()
    sides = []
    for side in (0, 1):
        own = t.filter(pa.array(keep == side))
        lists = [[v.values.to_numpy() for v in own.column(c)] for c in ("keys", "changes")]
        sides.append({"b": own.column("b").to_pylist(), "d": own.column("d").to_pylist(), "weight": own.column("weight").to_pylist(), "class": own.column("class").to_pylist(), "keys": lists[0], "changes": lists[1]})
    x, y = sides
    links = tile_links(x, y, similar) if x["b"] and y["b"] else []
    return pa.table([pa.array([x["b"][r] for r, _ in links], pa.int64()), pa.array([y["b"][c] for _, c in links], pa.int64())], ["a", "b"])


def undecided(members: DataFrame, classes_: DataFrame, similar: float) -> DataFrame:
    """(members that may be similar to others of their star that are not of their class, tiles of each star)."""
    named = lambda v: classes_.select(F.col("doc").alias(v), F.col("class").alias(f"c{v}"))
    slim = members.select("a", "b").join(named("b"), "b", "left").join(named("a"), "a", "left")
    slim = slim.select("a", "b", F.coalesce("cb", "b").alias("class"), (F.coalesce("cb", "b") != F.coalesce("ca", "a")).alias("open"))
    stars_ = slim.groupBy("a").agg(F.count("*").alias("n"), F.max("open").alias("any")).filter("n > 1 and any").select("a")
    slim = slim.join(stars_, "a")
    members = stage(members.join(slim, ["a", "b"]), "dedup-open")
    own = members.select("a", "b", F.explode(F.arrays_zip("keys", "changes")).alias("x")).select("a", "b", F.col("x.keys").alias("key"), F.col("x.changes").alias("change"))
    alone = own.groupBy("a", "key").agg(F.min("b").alias("b"), F.count("*").alias("n"), F.min("change").alias("change")).filter("n = 1").groupBy("a", "b").agg(F.sum("change").alias("alone"))
    kept = members.join(alone, ["a", "b"], "left").withColumn("alone", F.coalesce("alone", F.lit(0.0)))
    # Similar texts are at most k (|x| + |y|) apart. What is alone in x is not in y, and x is d(x) from the centre, so
    # their distance is at least d(y) - d(x) + 2 alone(x), and the same the other way round: near(x) >= far(y) and near(y) >= far(x).
    k = (1 - similar) / (1 + similar)
    kept = kept.withColumn("d", (F.col("weight") + F.col("a_weight")) * (1 - F.col("similar")) / (1 + F.col("similar")))
    kept = kept.withColumn("near", F.col("d") - 2 * F.col("alone") + k * F.col("weight")).withColumn("far", F.col("d") - k * F.col("weight"))
    # far(x) > k |centre| for an open x, which any partner must come near; and an open x itself must come near the least far.
    least = kept.groupBy("a").agg(F.min("far").alias("least"))
    kept = kept.join(least, "a").filter((F.col("near") >= F.col("least") - _TINY) & (F.col("open") | (F.col("near") >= k * F.col("a_weight") - _TINY)))
    return stage(kept.select("a", "b", "class", "open", "d", "weight", "keys", "changes"), "dedup-kept")


def between(kept: DataFrame, similar: float) -> DataFrame:
    """(a, b): links between texts of different classes, by tiles of open members and all members of a star."""
    tiles = lambda n, s: F.ceil(F.greatest(F.col(n) / float(TILE), F.col(s) / float(TILE_CHANGES))).cast("int")
    size = F.size("keys").cast("long")
    sums = kept.groupBy("a").agg(F.count("*").alias("n"), F.sum(size).alias("s"), F.count_if("open").alias("on"), F.sum(F.when(F.col("open"), size).otherwise(0)).alias("os"))
    sums = sums.filter("on > 0 and n > 1").select("a", tiles("on", "os").alias("across"), tiles("n", "s").alias("down"))
    dealt = kept.join(sums, "a")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))
    own = lambda n: F.pmod(F.xxhash64("b"), F.greatest(F.col(n), F.lit(1))).cast("int")
    body = ["b", "class", "d", "weight", "keys", "changes"]
    x = dealt.filter("open").select("a", *body, F.lit(0).alias("side"), own("across").alias("i"), all_of("down").alias("j"))
    y = dealt.select("a", *body, F.lit(1).alias("side"), all_of("across").alias("i"), own("down").alias("j"))
    # One key, so that tiles are dealt anew: rows dealt by a alone would leave all tiles of a star in one task.
    tiles_ = x.unionByName(y).select(F.struct("a", "i", "j").alias("tile"), "side", *body)
    return tiles_.groupBy("tile").applyInArrow(lambda t: _tile(t, similar), "a long, b long")


def text_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc, class of every text that is linked to another: every two that share a band bucket and are `similar` or more are of one class.

    docs: doc_id, doc (hash of the text), text, one row at least per text.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf_steps(docs))  # 2 x COUNTERS bytes
    rows = stage(signed(docs, shared).select("doc", F.posexplode("bands").alias("band", "h")).distinct(), "dedup-bands")
    near = stage(stars(rows), "dedup-stars")
    needed = near.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    one = docs.groupBy("doc").agg(F.min("doc_id").alias("doc_id")).join(needed, "doc", "left_semi")
    texts = stage(docs.join(one.select(F.col("doc").alias("_d"), F.col("doc_id").alias("_i")), (F.col("doc") == F.col("_d")) & (F.col("doc_id") == F.col("_i")), "left_semi").select("doc", "text").dropDuplicates(["doc"]), "dedup-texts")
    members = stage(_compared(_with_texts(near, texts), shared), "dedup-compared")
    first = stage(components(members.filter(F.col("similar") >= similar - _TINY).select("a", "b")), "dedup-first")
    more = stage(between(undecided(members, first, similar), similar).distinct(), "dedup-more")
    if more.isEmpty():
        return first
    # Classes that the further links join.
    named = lambda v: more.join(first.select(F.col("doc").alias(v), F.col("class").alias(f"c{v}")), v, "left").select("a", "b", F.coalesce(f"c{v}", v).alias(f"c{v}"))
    edges = named("a").join(named("b"), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = stage(components(edges), "dedup-joined").select(F.col("doc").alias("class"), F.col("class").alias("whole"))
    # A text that only the further links reach was no class before.
    every = first.unionByName(more.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(first, "doc", "left_anti").withColumn("class", F.col("doc")))
    return every.join(joined, "class", "left").select("doc", F.coalesce("whole", "class").alias("class"))


def components(edges: DataFrame) -> DataFrame:
    """doc, class (the smallest doc of its component) of every doc that has an edge (a, b).

    Alternating large-star and small-star steps: each is a few joins and
    aggregations over as many edges as there are, whatever the degree of a doc.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    now = stage(both, "dedup-edges")
    while True:
        # Large star: all larger neighbours of u link to the smallest of u and its neighbours.
        ways = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of u, and u, link to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = stage(small.filter("u != v").distinct(), "dedup-edges")
        # Done when every doc has one edge and no doc is both ends.
        open_ = new.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() or new.select(F.col("v").alias("u")).join(new.select("u"), "u", "left_semi").limit(1).count()
        now = new
        if not open_:
            break
    return now.select(F.col("u").alias("doc"), F.col("v").alias("class")).unionByName(now.select(F.col("v").alias("doc"), F.col("v").alias("class")).distinct())


def _text_classes(docs: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, doc, odd), (texts: doc, class_id, n_copies, kept: the text that stands for its class)."""
    keyed = docs.filter("text is not null and doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("doc"))
    rows = stage(docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.xxhash64("text")).alias("doc"), (F.col("text").isNull() | F.col("doc_id").isNull()).alias("odd")), "dedup-ids")
    own = text_classes(keyed, similar)
    texts = rows.filter("not odd").groupBy("doc").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"))
    texts = stage(texts.join(own, "doc", "left").withColumn("class", F.coalesce("class", "doc")), "dedup-classes")
    named = texts.groupBy("class").agg(F.min(F.struct("first", "doc")).alias("least"))
    texts = texts.join(named, "class").select("doc", F.col("least.first").alias("class_id"), "n_copies", (F.col("doc") == F.col("least.doc")).alias("kept"))
    # Staged, so that what joins it on doc is dealt anew and a text with many copies can be split.
    return rows, stage(texts, "dedup-named")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Class of every row of documents: doc_id, class_id (the smallest doc_id of the class), n_copies (rows with its text).

    Texts without words are similar only to equal texts; rows with a null text
    or a null doc_id are classes of their own (class_id = doc_id, n_copies 1).
    Texts are compared whole, however long. Repeated rows stay and share a class,
    ties of doc_id share the smallest. Other columns, whatever their names, take
    no part. No rows give no rows.
    """
    rows, texts = _text_classes(docs, similar)
    odd = rows.filter("odd").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    return rows.filter("not odd").join(texts, "doc").select("doc_id", "class_id", "n_copies").unionByName(odd)


def kept(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of each class with all columns, whatever their names: the smallest doc_id's.

    Rows with a null text or doc_id stay; of repeated rows one stays. Texts are
    compared whole, however long; empty ones are similar only to each other. Ties
    go to the smaller hash of the text. No rows give no rows.
    """
    _, texts = _text_classes(docs, similar)
    stay = stage(texts.filter("kept").select("doc", F.col("class_id").alias("id")), "dedup-stay")
    own = apart(docs, ["doc_id", "text"]).withColumn("h", F.xxhash64("text"))
    one = own.filter("text is not null and doc_id is not null").join(stay, (F.col("h") == F.col("doc")) & (F.col("doc_id") == F.col("id")), "left_semi").dropDuplicates(["h", "doc_id"])
    return together(one.unionByName(own.filter("text is null or doc_id is null")), docs.columns)
