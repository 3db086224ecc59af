import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from larkframe.llm import registry, simhash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def text_hash(text):
    return signed(xxhash.xxh64(text.encode(), seed=42).intdigest())


def brute_print(text):
    """Majority of the signed bits of the hashed word pairs, by plain loops."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    one = lambda w, seed: xxhash.xxh64(w.encode(), seed=seed).intdigest()
    hashes = [one(y, one(x, 42)) for x, y in zip(words, words[1:], strict=False)] or [one(w, 42) for w in words]
    votes = [sum(1 if h >> bit & 1 else -1 for h in hashes) for bit in range(64)]
    return f"{sum(1 << bit for bit, v in enumerate(votes) if v > 0):016x}"


def check(docs, rows):
    """Brute force of the whole result: every row, descending id and hash, null ids last."""
    texts = sorted(((r.doc_id, r.text or "") for r in docs), key=lambda x: (x[0] is not None, x[0] or 0, text_hash(x[1])), reverse=True)
    prints, expect = {}, []
    of = lambda t: prints.setdefault(t, brute_print(t))
    like = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
    for k, (doc, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        expect.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), of(text), of(edited), like(of(text), of(edited)), like(of(text), of(after))))
    assert sorted(map(str, expect)) == sorted(str(tuple(r)) for r in rows)
    return rows


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = check(docs, registry.op7_simhash(spark, sf).collect())
    same = {}
    for r in docs:
        same.setdefault(r.text, set()).add({x.doc_id: x.fingerprint for x in rows}[r.doc_id])
    assert all(len(v) == 1 for v in same.values())
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


def test_ranges_agree(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = sorted(simhash.digest(docs).collect())
    monkeypatch.setattr(simhash, "RANGE", 9)
    assert sorted(simhash.digest(docs.repartition(5)).collect()) == a


def test_odd_rows(odd_docs, no_docs, make_docs):
    rows = simhash.digest(odd_docs).collect()
    check(odd_docs.collect(), rows)
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {"0" * 16}
    assert simhash.digest(no_docs).count() == 0
    (one,) = simhash.digest(make_docs([(7, "a b c d e f")])).collect()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"a b c d a b").hexdigest()


def test_extreme_ids(make_docs):
    docs = make_docs([(i, f"text number {i} with words") for i in (-(2**62), -1, 0, 1, 2**62, 2**62 + 1)])
    check(docs.collect(), simhash.digest(docs).collect())


def test_repeated_rows_and_hot_ids(make_docs, monkeypatch):
    """Rows that repeat stay; ids that hold many rows, and nulls, are cut into ranges by hash."""
    monkeypatch.setattr(simhash, "RANGE", 4)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rows = [(5, f"text {k} of one id") for k in range(60)] + [(None, f"text {k} without id") for k in range(30)] + [(k, "the same words") for k in range(20)] + [(3, "again and again")] * 7
    docs = make_docs(rows)
    assert len(check(docs.collect(), simhash.digest(docs).collect())) == len(rows)
    ranges = docs.withColumn("h", F.xxhash64("text")).groupBy(simhash._ranges(docs, len(rows)).alias("r")).agg(F.count("*").alias("n"), F.countDistinct("h").alias("d")).collect()
    assert max(r.d for r in ranges) < 16


def test_long_texts(make_docs):
    docs = make_docs([(1, "a b c " * 70_000), (2, "x" * 300_000), (3, " " * 100_000 + "one")])
    check(docs.collect(), simhash.digest(docs).collect())


def test_near_fingerprints(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(150)]
    for v in values[:60]:
        x = v
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            x ^= 1 << b
        values.append(x)
    whole = [signed(v) for v in values]
    df = spark.createDataFrame([(v,) for v in [*whole, *whole[:9], None]], "fp long")
    for radius, blocks in ((3, 6), (1, 3), (0, 2)):
        got = sorted((r.a, r.b, r.distance) for r in simhash.near_fingerprints(df, radius, blocks).collect())
        own = sorted(set(whole))
        expect = [(a, b, d) for k, a in enumerate(own) for b in own[k + 1 :] if (d := bin((a ^ b) & (2**64 - 1)).count("1")) <= radius]
        assert got == sorted(expect)


def apart(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def test_near_in_full_buckets(spark, monkeypatch):
    """Fingerprints that agree on most bits are cut again and again; no pair is lost, none is there twice."""
    monkeypatch.setattr(simhash, "BUCKET", 16)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = {base[0] ^ x for x in range(64)} | {base[1] ^ x << 58 for x in range(64)}
    values |= {base[2] ^ 1 << i ^ 1 << j for i in range(0, 64, 9) for j in range(0, 64, 9)}
    own = sorted(signed(v) for v in values)
    df = spark.createDataFrame([(v,) for v in own], "fp long")
    for radius, blocks in ((2, 4), (1, 3)):
        got = sorted((r.a, r.b, r.distance) for r in simhash.near_fingerprints(df, radius, blocks).collect())
        assert got == sorted((a, b, d) for k, a in enumerate(own) for b in own[k + 1 :] if (d := apart(a, b)) <= radius)


def near_brute(docs, radius=3):
    prints = [(r.doc_id, brute_print(r.text or "")) for r in docs]
    sizes = {}
    for _, p in prints:
        sizes[p] = sizes.get(p, 0) + 1
    links = {p: [q for q in sizes if q != p and apart(int(p, 16), int(q, 16)) <= radius] for p in sizes}
    return sorted(str((d, p, sizes[p] - 1, len(links[p]), sum(sizes[q] for q in links[p]))) for d, p in prints)


def test_near_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted(str(tuple(r)) for r in registry.near_fingerprints(spark, sf).collect()) == near_brute(docs)


def test_near_odd_rows(odd_docs, no_docs, make_docs):
    assert sorted(str(tuple(r)) for r in simhash.near(odd_docs).collect()) == near_brute(odd_docs.collect())
    assert simhash.near(no_docs).count() == 0
    text = " ".join(f"w{k}" for k in range(400))
    docs = make_docs([(1, text), (1, text), (None, text), (2, text + " more"), (3, "something else")])
    rows = simhash.near(docs).collect()
    assert sorted(str(tuple(r)) for r in rows) == near_brute(docs.collect())
    # One added word turns no bit of this text's fingerprint, so that row is a copy too.
    assert brute_print(text) == brute_print(text + " more")
    assert [r.copies for r in rows if r.fingerprint == brute_print(text)] == [3, 3, 3, 3]


def test_near_is_not_broadcast(spark, sf):
    """However small Spark takes them to be, rows that grow with the texts are not gathered in the driver to be joined."""
    plan = registry.near_fingerprints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) >= 4
    assert not [line for line in joins if "SortMergeJoin" not in line and "LeftAnti" not in line]
