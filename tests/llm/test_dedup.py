import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkframe.llm import dedup, registry
from larkframe.llm.common import stage


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.class_id, set()).add(r.doc_id)
    return sorted(map(sorted, out.values()))


def brute(docs, steps, similar=dedup.SIMILAR):
    """Components of all pairs whose weighted Jaccard similarity, over dictionaries, is high enough."""
    ids = [d for d, _ in docs]
    vectors = []
    for _, text in docs:
        _, hashes, tf = dedup.shingles(pa.array([text]))
        vectors.append(dict(zip(hashes.tolist(), dedup.weights(dedup.rareness(hashes, steps), tf).tolist(), strict=True)))
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            same = docs[i][1] == docs[j][1]
            if same or a and b:
                shared = sum(min(w, b[x]) for x, w in a.items() if x in b)
                union = sum(a.values()) + sum(b.values()) - shared
                if same or shared / union >= similar:
                    parent[find(i)] = find(j)
    out = {}
    for k, i in enumerate(ids):
        out.setdefault(find(k), []).append(i)
    return sorted(map(sorted, out.values()))


def steps_of(docs):
    return dedup.idf_steps(docs.filter("text is not null").select("text"))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = registry.op2_dedup(spark, sf).collect()
    assert groups(rows) == brute([(r.doc_id, r.text) for r in docs.collect()], steps_of(docs))
    assert all(r.class_id == min(x.doc_id for x in rows if x.class_id == r.class_id) for r in rows)


def edited(rng, base, share):
    words = base.split()
    for k in rng.sample(range(len(words)), max(1, int(share * len(words)))):
        words[k] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def test_planted_copies(make_docs):
    """A large group of near copies with few and with many edits, some only similar to each other, and copies."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = " ".join(word() for _ in range(200))
    texts = [base] + [edited(rng, base, s) for s in (0.005, 0.01, 0.015, 0.02, 0.03, 0.05) for _ in range(12)]
    far = edited(rng, base, 0.06)
    texts += [far, edited(rng, far, 0.005), edited(rng, far, 0.01)]
    other = [" ".join(word() for _ in range(60)) for _ in range(40)]
    texts += other + [o + " one more" for o in other[:10]] + [base, base, far]
    docs = make_docs(list(enumerate(texts)))
    got = groups(dedup.classes(docs).collect())
    assert got == brute(list(enumerate(texts)), steps_of(docs))
    assert any(len(g) > 30 for g in got)


def family(n, seed=11):
    """Near copies of one text, edited at few up to many places: some are similar to the text, some only to others, most of the rest to none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    texts = [" ".join(base)]
    while len(texts) < n:
        words = (texts[rng.randrange(len(texts))].split() if rng.random() < 0.2 else list(base))
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            k = rng.randrange(len(words))
            if rng.random() < 0.3:
                del words[k]
            else:
                words[k] = rng.choice(base) if rng.random() < 0.5 else word()
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("tile", [16, 512])
def test_a_large_family_of_near_copies(make_docs, monkeypatch, tile):
    """Links outside the stars' classes are all found, whatever the tiles."""
    monkeypatch.setattr(dedup, "TILE", tile)
    texts = family(160)
    docs = make_docs(list(enumerate(texts)))
    expect = brute(list(enumerate(texts)), steps_of(docs))
    assert groups(dedup.classes(docs).collect()) == expect
    assert max(map(len, expect)) > 60 and sum(len(g) == 1 for g in expect) > 20


def test_rows_grow_with_a_family_and_not_with_its_pairs(make_docs):
    """The family at three sizes: links told and texts compared a member stay about the same."""
    told = []
    for n in (150, 300, 600):
        docs = make_docs(list(enumerate(family(n)))).selectExpr("doc_id", "xxhash64(text) as doc", "text")
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast(dedup.idf_steps(docs))
        rows = stage(dedup.signed(docs, shared).select("doc", F.posexplode("bands").alias("band", "h")).distinct(), "t")
        near = stage(dedup.stars(rows), "t")
        members = stage(dedup._compared(dedup._with_texts(near, docs), shared), "t")
        first = stage(dedup.components(members.filter("similar >= 0.8").select("a", "b")), "t")
        links = dedup.between(dedup.undecided(members, first, 0.8), 0.8)
        told.append((near.count() / n, links.count() / n))
    assert all(x < 9 and y < 1 for x, y in told)
    assert told[2][0] < 1.5 * told[0][0] and told[2][1] < 2 * told[0][1] + 0.2


def test_tile_links_are_a_spanning_forest():
    rng = np.random.default_rng(6)
    centre = (np.arange(40, dtype=np.uint64), np.ones(40))

    def side(n):
        out = {"weight": [], "d": [], "class": [], "keys": [], "changes": [], "own": []}
        for _ in range(n):
            keys = np.union1d(rng.choice(40, rng.integers(20, 40), replace=False), rng.choice(np.arange(40, 60), rng.integers(0, 8), replace=False)).astype(np.uint64)
            own = (keys, rng.integers(1, 3, len(keys)).astype(float))
            k, c = dedup.changed(centre, own)
            for name, x in (("weight", own[1].sum()), ("d", c.sum()), ("class", int(rng.integers(0, 30))), ("keys", k), ("changes", c), ("own", own)):
                out[name].append(x)
        return out

    for _ in range(20):
        x, y = side(12), side(25)
        links = dedup.tile_links(x, y, 0.5)
        sets, whole = dedup._Sets(), dedup._Sets()
        for i, a in enumerate(x["own"]):
            for j, b in enumerate(y["own"]):
                if dedup.similarity(a, b) >= 0.5:
                    whole.joined(x["class"][i], y["class"][j])
        assert all(dedup.similarity(x["own"][i], y["own"][j]) >= 0.5 for i, j in links)
        assert all(sets.joined(x["class"][i], y["class"][j]) for i, j in links)
        assert all((sets.of(a) == sets.of(b)) == (whole.of(a) == whole.of(b)) for a in range(30) for b in range(30))


def test_a_passage_of_all_texts_counts_less_than_what_is_rare(make_docs):
    """94 shingles in every text and 10 of a text's own: 94 / (94 + 20 * 1.25) = 0.79 is no link, though idf near 1 would make it one."""
    passage = " ".join(f"p{k}" for k in range(98))
    docs = make_docs([(d, passage + "".join(f" d{d}x{k}" for k in range(10))) for d in range(40)])
    assert all(r.class_id == r.doc_id for r in dedup.classes(docs).collect())


def test_odd_rows(odd_docs, no_docs):
    rows = dedup.classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].class_id == 1 and by[2].class_id == 2 and by[5].class_id == 5 and by[None].class_id is None
    assert by[3].class_id == by[4].class_id == 3 and by[3].n_copies == 3
    assert dedup.classes(no_docs).count() == 0 and dedup.kept(no_docs).count() == 0
    kept = dedup.kept(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "7", "8", "None"]


def test_same_id_for_different_texts(make_docs):
    docs = make_docs([(1, "a b c d e f g h"), (1, "p q r s t u v w"), (1, "a b c d e f g h"), (2, "a b c d e f g h")])
    assert sorted(r.text[0] for r in dedup.kept(docs).collect()) == ["a", "p"]


def test_samples_collide_as_often_as_texts_are_similar():
    """The share of equal bands tells the weighted similarity, here of single samples."""
    rng = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(400)])
    a = list(rng.choice(words, 300))
    texts = pa.array([" ".join(a), " ".join(a[:240] + list(rng.choice(words, 60)))])
    steps = np.full((2, dedup.COUNTERS), dedup.IDF_STEPS - 1, np.uint8)
    text, hashes, tf = dedup.shingles(texts)
    rare = dedup.rareness(hashes, steps)
    x, y = dedup._vectors(texts, steps)
    true = dedup.similarity(x, y)
    equal = []
    for salt in range(60):  # other elements, other draws
        _, own = dedup.bands(text, (hashes * np.uint64(2 * salt + 1) + np.uint64(salt)) & np.uint64((1 << 40) - 1), tf, rare)
        equal += (own[0] == own[1]).tolist()
    assert np.mean(equal) == pytest.approx(true**dedup.ROWS, abs=0.08)


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.doc: r["class"] for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent if any(a != b and x in (a, b) for a, b in edges)}


def test_short_texts_are_one_shingle():
    text, hashes, tf = dedup.shingles(pa.array(["a b", "A  b", "a b c d e", "", None, "a b c d e f"]))
    assert text.tolist() == [0, 1, 2, 5, 5] and tf.tolist() == [1] * 5
    assert hashes[0] == hashes[1] and hashes[2] in hashes[3:]
