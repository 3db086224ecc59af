"""Every registered statement and kernel against the oracle, on the smallest tables."""

import duckdb
import pytest

from larkframe.queries import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in registry.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, oracle, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    done = oracle.execute(ORACLE[name])
    columns = [c[0] for c in done.description]
    expect = sorted(repr(tuple(r[columns.index(n)] for n in names)) for r in done.fetchall())
    assert sorted(columns) == names and got == expect


def test_dense_groups_reach_the_largest_key(spark):
    orders = duckdb.sql("SELECT o_custkey, o_totalprice FROM read_parquet('/root/testdata/sf0.01/orders.parquet')").fetchall()
    expect = {k: [] for k in range(max(k for k, _ in orders) + 1)}
    for k, price in orders:
        if price > 400000:
            expect[k].append(price)
    got = {r["o_custkey"]: (r["count"], r["min"], r["max"]) for r in QUERIES["kernel_group_agg_dense"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) > 150
    assert got == {k: (len(v), min(v, default=None), max(v, default=None)) for k, v in expect.items()}


def test_row_numbers_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Equal prices of a part go by l_orderkey; what the SQL fixes is as in the SQL."""
    rows = [(k % 3, 40 - k, None if k % 5 == 4 else float(k % 4 // 2)) for k in range(40)]
    numbers, expect = {}, []
    for part, order, price in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[1])):
        numbers[part] = numbers.get(part, 0) + 1
        expect.append((part, order, price, numbers[part]))
    for k, some in enumerate((rows, rows[::-1], rows[::2] + rows[1::2])):
        at = str(tmp_path / f"{k}")
        spark.createDataFrame(some, "l_partkey long, l_orderkey long, l_extendedprice double").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
        got = [tuple(r) for r in QUERIES["win_row_number_partition"](spark, at).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, expect))
        sql = duckdb.connect()
        sql.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{at}/lineitem.parquet/*.parquet')")
        assert sorted(repr((p, x, n)) for p, _, x, n in got) == sorted(repr((p, x, n)) for p, _, x, n in sql.execute(ORACLE["win_row_number_partition"]).fetchall())
