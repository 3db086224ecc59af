"""Kernels on vectors with known results, and properties that hold for any input."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkframe import operators as K

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(df, name, order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_row_number(spark):
    got = column(K.row_number(spark.range(1000), "id"), "row_number", ["id"])
    assert got[0] == 1 and got[-1] == 1000 and len(got) == 1000


def test_peer_starts(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate([1, 1, 2, 2, 2, 3])], "at long, k int")
    assert column(K.peer_starts(df, "k", ties=["at"]), "peer_start", ["at"]) == [1, 0, 1, 0, 0, 1]


def test_peer_starts_with_nulls(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, 5)], "at long, k int")
    assert column(K.peer_starts(df, "k", ties=["at"]), "peer_start", ["at"]) == [1, 0, 1]


@pytest.mark.parametrize("build", [[1, 2, 3], [1, 2, 3, 3]])
def test_semi_join_agg(spark, build):
    b = spark.createDataFrame([(x,) for x in build], "k int")
    p = spark.createDataFrame([(2, 10.0), (3, 20.0), (3, 30.0), (5, 40.0), (None, 50.0)], "k int, v double")
    assert tuple(K.semi_join_agg(b, "k", p, "k", "v").first()) == (60.0, 3, 10.0, 30.0, 20.0)


def test_global_agg(spark):
    df = spark.range(10_000).selectExpr("id % 100 as v")
    assert tuple(K.global_agg(df, "v").first()) == (495_000.0, 10_000, 0.0, 99.0, 49.5)


def test_aggregates_without_values(spark):
    df = spark.createDataFrame([(1, None)], "k int, v double")
    assert tuple(K.global_agg(df, "v").first()) == (None, 0, None, None, None)
    assert tuple(K.group_agg(df, "k", "v").first()) == (1, None, 0, None, None, None)


def test_group_agg(spark):
    df = spark.range(10_000).selectExpr("id % 10 as k", "id % 100 as v")
    got = {r.k: r["count"] for r in K.group_agg(df, "k", "v").collect()}
    assert got == dict.fromkeys(range(10), 1000)
    dense = {r.k: r["count"] for r in K.group_agg(df, "k", "v", num_groups=12).collect()}
    assert dense == got | {10: 0, 11: 0}


def test_running_sum(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate([1, 2, 3, 4])], "at long, v int")
    assert column(K.running_sum(df, "v", "at"), "running_sum", ["at"]) == [1, 3, 6, 10]


@FEW
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=40), st.integers(2, 9))
def test_ranges_do_not_change_results(spark, keys, ranges):
    df = spark.createDataFrame(list(enumerate(keys)), "at long, k long").withColumn("s", F.col("k").cast("string"))
    for key in ("k", "s"):
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, (str(keys[i]) if key == "s" else keys[i]) if keys[i] is not None else 0, i))
        number = {i: n + 1 for n, i in enumerate(order)}
        text = {i: keys[i] for i in number}
        first = {x: min(number[i] for i in number if text[i] == x) for x in set(text.values())}
        dense = {x: n + 1 for n, x in enumerate(sorted(first, key=first.get))}
        kw = {"ranges": ranges}
        out = [K.row_number(df, key, ties=["at"], **kw), K.rank(df, key, **kw), K.dense_rank(df, key, **kw), K.peer_starts(df, key, ties=["at"], **kw)]
        numbers, ranks, denses, starts = ({r["at"]: r[-1] for r in x.collect()} for x in out)
        peers = spark.createDataFrame([(i, keys[i], starts[i]) for i in starts], "at long, k long, peer_start int").withColumn("s", F.col("k").cast("string"))
        sums = {r["at"]: r.running_sum for r in K.running_sum(peers, "peer_start", key, ties=["at"], **kw).collect()}
        assert numbers == number and ranks == {i: first[keys[i]] for i in number} and denses == sums == {i: dense[keys[i]] for i in number}
        assert starts == {i: int(number[i] == first[keys[i]]) for i in number}


def test_descending_and_peers(spark):
    df = spark.createDataFrame([(0, 1), (1, 3), (2, 3), (3, None)], "at long, k int")
    assert column(K.rank(df, "k", descending=True), "rank", ["at"]) == [3, 1, 1, 4]
    assert column(K.running_sum(df, "k", "k", peers=True), "running_sum", ["at"]) == [1, 7, 7, 7]
    assert column(K.rank(df, "k", partition=["at"]), "rank", ["at"]) == [1, 1, 1, 1]


def test_no_rows(spark):
    df = spark.range(0).selectExpr("id as at", "id as k")
    for f in (K.row_number, K.rank, K.dense_rank, K.peer_starts):
        assert f(df, "k").count() == 0
    assert K.running_sum(df, "k", "k").count() == 0


def test_groups_add_up_to_the_whole(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    parts = K.group_agg(items, "l_partkey", "l_quantity").selectExpr("sum(sum) as s", "sum(count) as n").first()
    whole = K.global_agg(items, "l_quantity").first()
    assert (parts.s, parts.n) == (whole["sum"], whole["count"])


def test_a_hot_key_is_cut_by_its_ties(spark, monkeypatch):
    """One key in 90 % of the rows, and nulls: no range holds many rows, and numbers are those of a plain window."""
    from larkframe.operators import ordered

    monkeypatch.setattr(ordered, "PER_RANGE", 100)
    df = spark.range(6000).selectExpr("id as at", "CASE WHEN id % 10 = 3 THEN id WHEN id % 50 = 0 THEN NULL ELSE 77 END as k", "id % 7 as v")
    for descending in (False, True):
        ranged = ordered._ranged(df, "k", descending, None, "at")
        loads = [r["count"] for r in ranged.groupBy("_range").count().collect()]
        assert max(loads) < 400
        plain = "k " + ("DESC" if descending else "ASC") + " NULLS LAST"
        df.createOrReplaceTempView("hot")
        expect = {r["at"]: r.n for r in spark.sql(f"SELECT at, ROW_NUMBER() OVER (ORDER BY {plain}, at) AS n FROM hot").collect()}
        got = {r["at"]: r.row_number for r in K.row_number(df, "k", ties=["at"], descending=descending).collect()}
        assert got == expect
    sums = {r["at"]: r.s for r in spark.sql("SELECT at, SUM(v) OVER (ORDER BY k ASC NULLS LAST, at ROWS UNBOUNDED PRECEDING) AS s FROM hot").collect()}
    assert {r["at"]: r.running_sum for r in K.running_sum(df, "v", "k", ties=["at"]).collect()} == sums
    peers = {r["at"]: (r.r, r.d, r.s) for r in spark.sql("SELECT at, RANK() OVER w AS r, DENSE_RANK() OVER w AS d, SUM(v) OVER w AS s FROM hot WINDOW w AS (ORDER BY k ASC NULLS LAST)").collect()}
    both = K.running_sum(K.dense_rank(K.rank(df, "k"), "k"), "v", "k", peers=True)
    assert {r["at"]: (r["rank"], r.dense_rank, r.running_sum) for r in both.collect()} == peers


def test_ranges_grow_with_rows(spark, monkeypatch):
    from larkframe.operators import ordered

    monkeypatch.setattr(ordered, "PER_RANGE", 5)
    monkeypatch.setattr(ordered, "BOUNDS", 16)
    df = spark.range(4000).selectExpr("id * 3 as k")
    loads = [r["count"] for r in ordered._ranged(df, "k", False, None).groupBy("_range").count().collect()]
    assert len(loads) > 400 and max(loads) < 40
    assert column(K.row_number(df, "k"), "row_number", ["k"]) == list(range(1, 4001))
