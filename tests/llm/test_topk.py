import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkframe.llm import registry, topk


def brute(rows, queries, k=5):
    """rows: (id, whole numbers)."""
    out = []
    for q, v in queries:
        dot = lambda w: min(max(int(np.dot(np.array(v, object), np.array(w, object))) if len(v) else 0, topk.LEAST), topk.MOST)  # noqa: B023, E731
        best = sorted((-dot(w), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 6), st.integers(1, 5), st.data())
def test_bit_slices(dim, k, data):
    n = data.draw(st.integers(1, 90))
    rows = np.array(data.draw(st.lists(st.lists(st.integers(-300, 300), min_size=dim, max_size=dim), min_size=n, max_size=n)), np.int64).reshape(n, dim)
    q = np.array(data.draw(st.lists(st.lists(st.integers(-300, 300), min_size=dim, max_size=dim), min_size=1, max_size=4)), np.int64)
    q = q.reshape(len(q), dim)
    index = topk.BitSlices(rows)
    out = list(index.best(q, k, np.zeros((len(q), index.every.size), np.uint64)))
    for x, (at, scores) in zip(q, out, strict=True):
        expect = sorted((-int(s), i) for i, s in enumerate(rows @ x))[:k]
        assert sorted(zip((-scores).tolist(), at.tolist(), strict=True)) == expect


def test_whole_table(spark, sf):
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding, np.float64)).astype(int).tolist()) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(registry.op4_topk(spark, sf)) == brute(rows, [r for r in rows if r[0] % 50 == 0])


def test_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-9, 9, 4).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, v array<int>")
    monkeypatch.setattr(topk, "BLOCK", 37)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    assert found(topk.top_k(df, df.filter("vec_id % 20 = 0"))) == brute(rows, [r for r in rows if r[0] % 20 == 0])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [1.0, 2.0]), (50, [-1.0, 0.5, 2.0]), (51, [0.001, -0.001, 3.0]), (100, []), (7, [1.0, 2.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, score int")
    v = topk.quantised(df)
    kept = [(0, [256, 512]), (5, [256, 512]), (6, [256, 512]), (7, [256, 512]), (50, [-256, 128, 512]), (51, [0, -1, 768]), (100, [])]
    assert found(topk.top_k(v, v.filter("vec_id % 50 = 0"))) == brute(kept, [r for r in kept if r[0] % 50 == 0])
    none = v.limit(0)
    assert topk.top_k(none, none).count() == 0 and topk.top_k(v, none).count() == 0


def test_large_components_take_part(spark, monkeypatch):
    """No finite vector is left out, and scores are exact as far as they fit a long."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(-9, 9, 3) * 10.0 ** int(rng.integers(0, 6))).tolist()) for i in range(60)]
    rows += [(100, [600000.0, 1.0, -3.0]), (150, [2.0**31, -(2.0**30), 0.5]), (200, [1e12, 1e3, -1e12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    v = topk.quantised(df)
    expect = brute(whole, [r for r in whole if r[0] % 50 == 0])
    assert found(topk.top_k(v, v.filter("vec_id % 50 = 0"))) == expect
    assert any(i == 100 for _, _, i, _ in expect)
    huge = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, -1.0]), (2, [-3e38, 0.0])], "vec_id long, embedding array<float>")
    v = topk.quantised(huge)
    assert found(topk.top_k(v, v.filter("vec_id = 0"))) == [(0, 1, 1, topk.MOST), (0, 2, 2, topk.LEAST)]


def test_rows_in_another_order_give_the_same(spark, sf):
    v = topk.quantised(spark.read.parquet(f"{sf}/embeddings.parquet"))
    mixed = v.orderBy(F.xxhash64("vec_id")).repartition(3)
    assert found(topk.top_k(v, v.filter("vec_id % 50 = 0"))) == found(topk.top_k(mixed, mixed.filter("vec_id % 50 = 0")))


@pytest.mark.parametrize("k", [1, 3])
def test_ties_go_to_the_smaller_id(spark, k):
    df = spark.createDataFrame([(i, [1, 1]) for i in range(40)], "vec_id long, v array<int>")
    got = found(topk.top_k(df, df.filter("vec_id = 0"), k))
    assert got == [(0, r + 1, r + 1, 2) for r in range(k)]
