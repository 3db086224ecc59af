import pyarrow as pa
import pytest

from larkframe.llm import common
from pyspark.sql import SparkSession

from larkframe.llm import common


def test_stage_and_release(spark: SparkSession):
    df = common.stage(spark.range(5), "x")
    assert df.count() == 5 and common.shared_dir(spark) in df.inputFiles()[0]
    assert common.shared_dir(spark) == common.shared_dir(spark)
    assert common.release(spark)
    assert not common.release(spark)


def test_words_and_columns(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\tb\x0bc ",), ("a\xa0b",)], "text string")
    assert [r.n for r in df.select(common.n_words(df.text).alias("n")).collect()] == [0, 0, 3, 1]
    assert common.only(df.withColumn("a b", df.text), ["a b"]).columns == ["a b"]
    assert [common.blocks_of(n, 10) for n in (0, 1, 10, 11)] == [1, 1, 1, 2]


def test_slices_hold_bounded_text(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 10)
    monkeypatch.setattr(common, "SLICE_ROWS", 4)
    texts = ["a" * 25, None, "", "b" * 3, "c" * 8, "", "", "", "", "", "d" * 30, "e"]
    for kind in (pa.string(), pa.large_string()):
        for at in (0, 3):
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, kind)], ["k", "text"]).slice(at)
            parts = [b.column(1).to_pylist() for b in common.in_slices([batch], 1)]
            assert [t for p in parts for t in p] == texts[at:]
            assert all(0 < len(p) <= 4 and (len(p) == 1 or sum(len(t or "") for t in p) <= 10) for p in parts)
    assert list(common.in_slices([pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["t"])], 0)) == []


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())
