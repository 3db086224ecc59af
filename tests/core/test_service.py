"""Catalog, engine, plans, formats, command line and generator."""

import base64
import json

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from larkframe import errors, formats, jupyter, plans
from larkframe.api import Engine
from larkframe.cli import main
from larkframe.sources import Catalog, generate
from larkframe.sources.generator import order_items, orders


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    pq.write_table(pa.table({"id": pa.array(range(5), pa.int64()), "status": ["a", "b", None, "a", "b"], "big": [2**53 + 1] * 5}), at / "orders.parquet")
    pq.write_table(pa.table({"id": pa.array([], pa.int64())}), at / "my-table.parquet")
    schema = pa.schema([pa.field("k", pa.int32(), nullable=False), pa.field("u", pa.uint32())])
    pq.write_table(pa.table({"k": pa.array([1], pa.int32()), "u": pa.array([4_000_000_000], pa.uint32())}, schema=schema), at / "tëst.parquet")
    (at / "notes.txt").write_text("x")
    return str(at)


@pytest.fixture(scope="module")
def engine(spark, folder):
    return Engine(folder, spark=spark)


def test_tables(engine, folder):
    got = {t["name"]: t for t in engine.list_tables()["tables"]}
    assert set(got) == {"orders", "my-table", "tëst"}
    assert got["orders"]["num_rows"] == 5 and got["my-table"]["num_rows"] == 0
    assert got["orders"]["file_size_bytes"] > 0 and got["orders"]["file_path"].endswith("orders.parquet")
    assert got["tëst"]["columns"] == [{"name": "k", "data_type": "int", "nullable": False}, {"name": "u", "data_type": "bigint", "nullable": True}]
    json.dumps(engine.list_tables())


def test_odd_names_can_be_queried(engine):
    assert engine.execute("SELECT COUNT(*) AS n FROM `my-table`").n.tolist() == [0]
    assert engine.execute("SELECT u FROM `tëst`").u.tolist() == [4_000_000_000]


def test_folder_errors(spark, tmp_path):
    with pytest.raises(errors.CatalogError) as e:
        Catalog(spark).add_folder(str(tmp_path / "none"))
    assert e.value.code == -2
    with pytest.raises(errors.CatalogError) as e:
        Catalog(spark).add_folder(str(tmp_path))
    assert e.value.code == -3


def test_data_path(spark, folder, monkeypatch):
    monkeypatch.setenv("DATA_PATH", folder)
    assert len(Catalog(spark).add_folder()) == 3


def test_files(spark, folder):
    c = Catalog(spark)
    assert [t.name for t in c.add_files([f"{folder}/orders.parquet"], ["o2"])] == ["o2"]
    assert c.frame("o2").count() == 5
    for files, names in ([f"{folder}/orders.parquet"], ["a", "b"]), ([f"{folder}/gone.parquet"], None), ([f"{folder}/orders.parquet"] * 2, None):
        with pytest.raises(errors.ArgumentError):
            Catalog(spark).add_files(files, names)


@pytest.mark.parametrize(
    ("sql", "kind", "word"),
    [
        ("SELECT nope FROM orders", errors.ColumnError, "column"),
        ("SELECT * FROM nowhere", errors.TableError, "table"),
        ("SELECT FROM orders", errors.ParseError, "parse"),
        ("selec * from orders", errors.ParseError, "parse"),
        ("SELECT id + 'abc' FROM orders", errors.ExecutionError, "abc"),
        ("DROP VIEW orders", errors.SqlError, "read-only"),
    ],
)
def test_errors(engine, sql, kind, word):
    with pytest.raises(kind, match=word) as e:
        engine.execute(sql)
    assert isinstance(e.value, RuntimeError) and "code -5" in str(e.value)


def test_results(engine):
    empty = engine.execute("SELECT id, status FROM orders WHERE id > 100")
    assert list(empty.columns) == ["id", "status"] and not len(empty)
    assert engine.execute("SELECT big FROM orders LIMIT 1").big.tolist() == [2**53 + 1]
    joined = engine.to_arrow("SELECT * FROM orders a JOIN orders b ON a.id = b.id")
    assert joined.column_names == ["id", "status", "big"] * 2
    assert engine.execute("SELECT * FROM orders a JOIN orders b ON a.id = b.id").shape == (5, 6)
    done = engine.run("WITH t AS (SELECT 1 AS x) SELECT * FROM t")
    assert 0 < done.execution_time_ms <= done.total_time_ms
    assert engine.execute("-- a note\nSELECT 1 AS x").x.tolist() == [1]


def test_functions(engine):
    got = engine.execute("SELECT strpos('abc', 'c') AS a, starts_with('abc', 'ab') AS b, to_hex(255) AS c, gcd(12, 18) AS d, lcm(4, 6) AS e, array_to_string(array('x','y'), '-') AS f, array_length(string_to_array('a.b.c', '.')) AS g, date_bin(INTERVAL '15' MINUTE, TIMESTAMP '2024-01-01 10:37:00', TIMESTAMP '2024-01-01 00:00:00') AS h").iloc[0]
    assert got.tolist() == [3, True, "ff", 6, 12, "x-y", 3, pd.Timestamp("2024-01-01 10:30:00")]


def test_info(engine):
    info = engine.info()
    assert info["engine"] == "Apache Spark" and info["available"] is False and engine.accelerator_available() is False


def test_formats():
    frame = pd.DataFrame({"n": [1, 22], "s": ["a", None]})
    assert formats.pretty(frame).splitlines() == ["+----+---+", "| n  | s |", "+----+---+", "|  1 | a |", "| 22 |   |", "+----+---+"]
    assert formats.pretty(frame.head(0)) == "(empty result)"
    assert formats.csv(frame) == "n,s\n1,a\n22,\n"


def test_mimebundle(spark):
    got = formats.mimebundle(spark.range(150))
    assert "more than 100 rows" in got["text/plain"] and got["text/html"].count("<tr>") == 101
    assert "<tr>" in formats.mimebundle(spark.range(2))["text/html"]
    with pa.ipc.open_stream(base64.b64decode(got[formats.ARROW])) as stream:
        assert stream.read_all().column("id").to_pylist() == list(range(100))


def test_cells(engine):
    assert jupyter.execute_cell(engine, "SELECT 1 AS x")[1]["text/plain"].count("x") == 1
    reply, bundle, error = jupyter.execute_cell(engine, "SELECT nope FROM orders")
    assert reply["status"] == "error" and bundle is None and "column" in error
    assert jupyter.execute_cell(engine, "SELECT nope", silent=True)[0]["status"] == "ok"


@pytest.mark.parametrize(
    ("sql", "kind"),
    [
        ("SELECT COUNT(*) AS n FROM orders", "Aggregation"), ("SELECT status, COUNT(*) AS n FROM orders GROUP BY status", "GroupBy"), ("SELECT a.id FROM orders a JOIN orders b ON a.id = b.id", "HashJoin"),
        ("SELECT RANK() OVER (PARTITION BY status ORDER BY id) AS r FROM orders", "Window"), ("SELECT id FROM orders WHERE id > 2", "Filter"), ("SELECT id FROM orders", "TableScan"),
        ("SELECT a.status, COUNT(*) AS n FROM orders a JOIN orders b ON a.id = b.id GROUP BY a.status", "Complex"), ("SELECT 1 AS x", "Unsupported"),
    ],
)
def test_classify(engine, sql, kind):
    assert plans.classify(engine.sql(sql)).operation == kind


def test_plans(engine):
    df = engine.sql("SELECT id FROM orders WHERE id > 2")
    assert "Filter" in plans.logical_text(df) and "FileScan parquet" in plans.physical_text(df)
    assert any("GreaterThan(id,2)" in x for x in plans.pushed_filters(df))
    assert "ReadSchema: struct<id:bigint>" in plans.physical_text(df)


def test_manifest(engine, spark, tmp_path):
    made = plans.export(engine.catalog, "SELECT status, COUNT(*) AS n FROM orders GROUP BY status", str(tmp_path / "m.json"))
    got = plans.read(str(tmp_path / "m.json"))
    assert got == made and got.tables["orders"]["format"] == "parquet" and got.plan
    assert plans.replay(Catalog(spark), got).count() == 3
    with pytest.raises(errors.ArgumentError):
        plans.Manifest.from_json('{"version": "9"}')


def test_command_line(folder, tmp_path, capsys, spark):
    files = ["-f", f"{folder}/orders.parquet"]
    assert main(["run", "-q", "SELECT id FROM orders ORDER BY id LIMIT 1", *files]) == 0
    assert capsys.readouterr().out.splitlines()[-2] == "|  0 |"
    assert main(["run", "-q", "SELECT id FROM t ORDER BY id LIMIT 1", *files, "-t", "t", "--csv", "-v"]) == 0
    got = capsys.readouterr()
    assert got.out == "id\n0\n" and "Total time" in got.err
    assert main(["run", "-q", "SELECT nope FROM orders", *files]) == 1
    for how in ("--explain-only", "--physical-plan", "--plan-json", "--manifest"):
        assert main(["run", "-q", "SELECT id FROM orders", *files, how, "-o", str(tmp_path / "out")]) == 0
        assert (tmp_path / "out").read_text()
    assert main(["tables", "-d", folder]) == 0
    assert len(json.loads(capsys.readouterr().out)["tables"]) == 3


def test_generator(spark, tmp_path):
    a, b = orders(spark, 2000), orders(spark.newSession(), 2000).repartition(3)
    assert sorted(a.collect()) == sorted(b.collect())
    low, high, n, states = a.selectExpr("min(amount)", "max(amount)", "count(distinct id)", "count(distinct status)").first()
    assert 10 <= low and high < 1000 and n == 2000 and states == 4
    items = order_items(spark, 500)
    assert items.count() == items.select("id").distinct().count()
    per = items.groupBy("order_id").count().selectExpr("min(count) as a", "max(count) as b", "count(*) as n").first()
    assert per.a >= 1 and per.b <= 10 and per.n == 500
    generate(spark, "orders", 10, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 10
    with pytest.raises(ValueError):
        generate(spark, "nothing", 1, str(tmp_path / "x"))
