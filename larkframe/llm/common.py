"""Shared helpers of the training-data operators: tables, staging, whole-text words."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read only through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on one machine."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = spark.conf.get("spark.larkframe.local.shared", "")
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='larkframe-')}"
        spark.conf.set("spark.larkframe.local.shared", at)
    return at


def _staged(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stage/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> bool:
    """Deletes all tables that this application has staged; results that were not written elsewhere go with them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_staged(spark))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again.

    This cuts the lineage: what follows survives lost executors and does not
    repeat the work before it.
    """
    spark = df.sparkSession
    at = f"{_staged(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: Bytes of text that a slice of a batch holds at most (one text at least), and its rows.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 512


def in_slices(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of bounded text, so that what a worker holds does not depend on a session's batch size."""
    for batch in batches:
        texts = batch.column(column)
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, int(ends[at]) + SLICE_BYTES, "right")) - 1
            stop = min(max(stop, at + 1), at + SLICE_ROWS, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def apart(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    """The needed columns, and all columns of a row as one struct `whole`: names of the caller's cannot clash then."""
    columns = df.columns
    return df.select(*[F.col(f"`{c}`") for c in needed if c in columns], F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole"))


def together(df: DataFrame, columns: list[str]) -> DataFrame:
    """The caller's rows again, from `whole`."""
    return df.select(*[F.col("whole").getField(c).alias(c) for c in columns])


def n_words(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def only(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The named columns and no others, so that extra columns never clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def blocks_of(rows: int, each: int) -> int:
    """How many blocks of about `each` rows; at least 1."""
    return max(1, -(-rows // each))


def vocabulary_path(name: str, root: str | None = None) -> str:
    """Where a public vocabulary file is; `root` overrides the installed package."""
    if root:
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)
