"""SimHash fingerprints of whole texts and the search for near ones, in DataFrame functions only.

Terms are pairs of adjacent words (a one-word text is its own term), weighted by
how often they occur. Each term's 64-bit hash votes on every bit; a bit of the
fingerprint is set where more than half of the weight votes for it. Two bits'
votes share one long (32 bits each, enough for any text that fits a column), so
a term adds 32 longs and not 64. All terms of a text are in one task, where they
are summed up: only sums are shuffled.

Near fingerprints: 64 bits are cut into `blocks` blocks; two fingerprints within
the radius agree on at least blocks - radius of them. There is one table for each
choice of that many blocks, keyed by the chosen bits moved to the front. A key
with many fingerprints is cut again by the bits that its table leaves out.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkframe.llm.common import stage

BITS = 64
_LANES = BITS // 2
_SPACE = " \t\n\x0b\x0c\r"
#: Rows in a range of the order that one task sorts.
RANGE = 2000
MOST_BOUNDS = 512
#: Ranges whose heads one task orders.
BLOCK = 1 << 16
#: Fingerprints of one key of a block table that are compared pairwise. Cutting a key again makes up to 20 rows of each
#: of its fingerprints a level (three levels at most), so below this pairs are cheaper.
BUCKET = 1 << 14


def terms(text: Column) -> Column:
    """Hashes of a text's terms, an array with repeats; null without words."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    # An array of one array, so that the words are found once however often they are used.
    words = F.array(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b))
    own = F.element_at(F.transform(words, lambda w: F.when(F.size(w) < 2, F.transform(w, lambda x: F.xxhash64(x))).otherwise(pairs(w))), 1)
    return F.when(trimmed != "", own)


def _votes() -> list[Column]:
    """Per lane, the sum of the votes for bits k and k + 32."""
    low = F.lit(0x0000000100000001)
    return [F.sum(F.shiftrightunsigned("term", k).bitwiseAND(low)).alias(f"v{k}") for k in range(_LANES)]


def _bits() -> Column:
    """The fingerprint from lane sums and the number of votes n."""
    total = F.lit(0).cast("long")
    for k in range(_LANES):
        both = F.coalesce(F.col(f"v{k}"), F.lit(0))
        total = total.bitwiseOR(F.when(both.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("n"), F.lit(1 << k)).otherwise(F.lit(0).cast("long")))
        high = (1 << (k + 32)) if k < 31 else -(1 << 63)
        total = total.bitwiseOR(F.when(F.shiftrightunsigned(both, 32) * 2 > F.col("n"), F.lit(high)).otherwise(F.lit(0).cast("long")))
    return total


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """`keys`, fp (long) and n_rows for each distinct value of the keys, which must determine the text. Null or without words: 0."""
    each = texts.select(*keys, F.posexplode_outer(terms(F.coalesce(text, F.lit("")))).alias("pos", "term"))
    # Repeated rows multiply all votes alike; their first terms tell how many there are.
    n_rows = F.sum(F.when(F.col("pos") > 0, 0).otherwise(1)).alias("n_rows")
    return each.groupBy(*keys).agg(F.count("term").alias("n"), n_rows, *_votes()).select(*keys, _bits().alias("fp"), "n_rows")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def as_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _ranges(rows: DataFrame, n: int) -> Column:
    """A range number that grows with (doc_id, h), nulls lowest, about RANGE rows each.

    Bounds are at quantiles of doc_id, and each range between two is cut evenly. An
    id that holds several quantiles has ranges of its own by h, and so have nulls.
    """
    if not n:
        return F.lit(0).cast("long")
    count = min(MOST_BOUNDS, -(-n // RANGE))
    found, nulls = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / count) for k in range(count + 1)]), F.lit(20 * MOST_BOUNDS)), F.count_if(F.col("doc_id").isNull())).first()
    found = sorted(found or [0])
    bounds = sorted(set(found))
    parts = -(-n // (RANGE * count))
    several = [(found.count(b) - 1) * parts for b in bounds]
    of_null = max(1, -(-nulls // RANGE))
    width = max(parts, of_null, *several)
    x, edges = F.col("doc_id"), F.array(*[F.lit(b).cast("long") for b in bounds])
    at = F.size(F.filter(edges, lambda b: b <= x))
    own = F.element_at(F.array(*[F.lit(s) for s in several]), F.greatest(at, F.lit(1)))
    low, high = [F.element_at(edges, F.greatest(F.least(i, F.lit(len(bounds))), F.lit(1))).cast("double") for i in (at, at + 1)]
    by_hash = lambda k: F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * k), k - 1)
    by_id = F.when(high > low, F.greatest(F.least(F.floor((x.cast("double") - low) / (high - low) * parts), F.lit(parts - 1)), F.lit(0))).otherwise(0)
    hot = (at > 0) & (low == x.cast("double")) & (own > 0)
    number = F.when(x.isNull(), by_hash(F.lit(of_null))).when(hot, (2 * at + 1) * width + by_hash(own)).otherwise((2 * at + 2) * width + by_id)
    return number.cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """All rows (doc_id, h, text) with the next one by descending (doc_id, h), null ids last, the first after the last.

    Rows are ordered within ranges of doc_id; the last row of a range is
    followed by the head of the next range that has rows, which is found in two
    levels, so that only as many heads as a block of ranges has are in one place.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("range", _ranges(docs, docs.count()))
    ids = ["doc_id", "h"]
    slim = rows.groupBy("range").agg(F.max(F.struct(*ids)).alias("head")).withColumn("block", F.floor(F.col("range") / BLOCK))
    slim = stage(slim, "simhash-ranges")
    order = Window.orderBy(F.desc("block"))
    first = slim.groupBy("block").agg(F.max(F.struct("range", "head"))["head"].alias("first"))
    first = first.select("block", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("first"))
    heads = slim.join(first, "block").select("range", F.coalesce(F.lead("head").over(Window.partitionBy("block").orderBy(F.desc("range"))), "first").alias("head"))
    heads = stage(heads, "simhash-heads")
    texts = rows.select(*ids, "text").join(
        heads.select(F.col("head.doc_id").alias("_d"), F.col("head.h").alias("_h")).distinct().hint("broadcast" if heads.count() <= 200_000 else "merge"),
        F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left_semi",
    )
    texts = texts.dropDuplicates(ids)
    follow = heads.join(texts, heads["head.doc_id"].eqNullSafe(texts["doc_id"]) & (heads["head.h"] == texts["h"])).select("range", F.struct(texts["doc_id"], "h", "text").alias("after"))
    within = Window.partitionBy("range").orderBy(F.desc("doc_id"), F.desc("h"))
    return rows.withColumn("n1", F.lead(F.struct(*ids, "text")).over(within)).join(follow, "range").withColumn("after", F.coalesce("n1", "after")).drop("n1", "range")


def digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likeness; one row per row.

    The edited text: the last floor(n / 3) code points replaced by the first as
    many (or all) of the next document by descending doc_id; ties of doc_id go by
    the hash of the text, and the next document of a repeated row is its next copy,
    if any. Null texts count as empty; without words a fingerprint is 0. Texts are
    taken whole, however long. Other columns, whatever their names, take no part.
    No rows give no rows.
    """
    rows = with_next(docs.select("doc_id", "text"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("after.text", F.lit(1), cut))
    rows = rows.select("doc_id", "h", F.col("after.doc_id").alias("nd"), F.col("after.h").alias("nh"), n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))))
    keys = ["doc_id", "h", "nd", "nh", "n_chars", "sha"]
    rows = rows.select(*keys, both.alias("x")).select(*keys, "x.kind", "x.t")
    fps = fingerprints(rows, [*keys, "kind"], "t")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("fp")))
    wide = stage(fps.groupBy(*keys).agg(of(0).alias("fp"), of(1).alias("edited_fp"), F.max("n_rows").alias("n_rows")), "simhash-fps")
    near = wide.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("fp").alias("next_fp")).distinct()
    out = wide.join(near, F.col("nd").eqNullSafe(F.col("_d")) & (F.col("nh") == F.col("_h"))).withColumn("row", F.explode(F.sequence(F.lit(1), "n_rows")))
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def _tables(bits: int, radius: int, blocks: int) -> list[list[tuple[int, int]]]:
    """Per choice of blocks - radius of the blocks of `bits` bits, their spans (from, to)."""
    edge = [bits * k // blocks for k in range(blocks + 1)]
    return [[(edge[k], edge[k + 1]) for k in chosen] for chosen in combinations(range(blocks), blocks - radius)]


def _others(bits: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans between those given."""
    edges = [0, *[e for span in spans for e in span], bits]
    return [(lo, hi) for lo, hi in zip(edges[::2], edges[1::2], strict=True) if lo < hi]


def _gathered(x: Column, spans: list[tuple[int, int]]) -> Column:
    """The bits of the spans, moved together."""
    out, at = F.lit(0).cast("long"), 0
    for lo, hi in spans:
        bits = F.shiftrightunsigned(x, lo) if hi - lo == BITS else F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        out, at = out.bitwiseOR(F.shiftleft(bits, at)), at + hi - lo
    return out


def near_fingerprints(fps: DataFrame, radius: int = 3, blocks: int = 6, fp: str = "fp") -> DataFrame:
    """All pairs (a, b, distance), a < b, of distinct fingerprints at most `radius` bits apart, each once.

    Equal fingerprints are one value here; join the pairs with their rows for
    members. Null fingerprints take no part. Values that share a key of a table are
    compared pairwise up to BUCKET of them. Beyond, they can differ only in the
    bits that the table leaves out, which are cut into blocks again, so that no
    key has more than BUCKET values in the end and no pair is lost.
    """
    rows = stage(fps.select(F.col(fp).alias("a")).filter("a is not null").distinct(), "simhash-values")
    rows = rows.select("a", F.lit(0).cast("long").alias("bucket"), F.col("a").alias("x"))
    bits, found = BITS, []
    while True:
        tables = _tables(bits, radius, blocks)
        # Buckets are named by hashes: a collision only adds pairs to compare.
        entry = [F.struct(F.xxhash64("bucket", F.lit(t), _gathered(F.col("x"), spans)).alias("bucket"), _gathered(F.col("x"), _others(bits, spans)).alias("x")) for t, spans in enumerate(tables)]
        keyed = rows.select("a", F.explode(F.array(*entry)).alias("e")).select("a", "e.bucket", "e.x")
        left = max(sum(hi - lo for lo, hi in _others(bits, spans)) for spans in tables)
        last = left >= bits or 1 << left <= BUCKET
        light = keyed
        if not last:
            full = stage(keyed.groupBy("bucket").count().filter(F.col("count") > BUCKET).select("bucket"), "simhash-full")
            light = keyed.join(full, "bucket", "left_anti")
        # Merged: Spark takes exploded rows to be as small as their fingerprints, and would broadcast all tables at once.
        other = light.select(F.col("a").alias("b"), "bucket").hint("merge")
        distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        found.append(light.select("a", "bucket").join(other, "bucket").filter((F.col("a") < F.col("b")) & (distance <= radius)).select("a", "b", distance.alias("distance")))
        if last or full.isEmpty():
            break
        rows, bits = stage(keyed.join(full, "bucket", "left_semi"), "simhash-deeper"), left
    return reduce(DataFrame.unionAll, found).distinct()


def near(docs: DataFrame, radius: int = 3) -> DataFrame:
    """How many documents each document has near it, by SimHash; one row per row.

    Returns doc_id, fingerprint, copies (other rows with this fingerprint), links
    (other fingerprints at most `radius` bits away), near (rows with one of those).
    Null texts count as empty; all texts without words share the fingerprint 0.
    Texts are taken whole, however long; repeated rows are copies; ties do not
    matter. Other columns, whatever their names, take no part. No rows give no rows.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    fps = stage(fingerprints(texts, ["doc_id", "h"]), "simhash-fps")
    sizes = fps.groupBy("fp").agg(F.sum("n_rows").alias("members"))
    pairs = near_fingerprints(fps, radius)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("fp")), F.struct(F.col("b").alias("own"), F.col("a").alias("fp")))).alias("e")).select("e.*")
    # Sizes and links grow with the texts, so the driver must never hold them.
    links = ends.join(sizes.hint("merge"), "fp").groupBy(F.col("own").alias("fp")).agg(F.count("*").alias("links"), F.sum("members").alias("near"))
    rows = fps.join(sizes.join(links.hint("merge"), "fp", "left").hint("merge"), "fp").withColumn("row", F.explode(F.sequence(F.lit(1), "n_rows")))
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", as_text(F.col("fp")).alias("fingerprint"), (F.col("members") - 1).alias("copies"), F.coalesce("links", zero).alias("links"), F.coalesce("near", zero).alias("near"))
