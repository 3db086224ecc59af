"""The engine: SQL over a catalog of Parquet tables."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkframe import functions
from larkframe.errors import ParseError, SqlError, mapped
from larkframe.session import session
from larkframe.sources.catalog import Catalog

_NO_LIST = re.compile(r"\s*select\s+from\b", re.IGNORECASE)
_READS = re.compile(r"\s*(\(|--[^\n]*\n|/\*.*?\*/)*\s*(select|with|values|from|table|describe|desc|show|explain)\b", re.IGNORECASE | re.DOTALL)


@dataclass(frozen=True)
class Timed:
    """A result and its times in milliseconds: planning and running, and running alone."""

    frame: pd.DataFrame
    total_time_ms: float
    execution_time_ms: float


class Engine:
    """Runs read-only SQL over the Parquet files of a folder, or of a list."""

    def __init__(self, data_path: str | None = None, files: list[str] | None = None, names: list[str] | None = None, spark: SparkSession | None = None):
        self.spark = spark or session()
        self.catalog = Catalog(self.spark)
        functions.register(self.spark)
        if files:
            self.catalog.add_files(files, names)
        else:
            self.catalog.add_folder(data_path)

    def sql(self, query: str) -> DataFrame:
        """The planned query; nothing runs until its rows are asked for."""
        if _NO_LIST.match(query):
            raise ParseError("cannot parse the statement: SELECT without columns")
        try:
            if not _READS.match(query):
                self.spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
                raise SqlError("only queries can be run; tables are read-only")
            return self.spark.sql(query)
        except Exception as e:
            raise mapped(e) from e

    def execute(self, query: str) -> pd.DataFrame:
        """The result as a frame; one without rows keeps its columns."""
        return self.run(query).frame

    def to_arrow(self, query: str) -> pa.Table:
        df = self.sql(query)
        try:
            return df.toArrow()
        except Exception as e:
            raise mapped(e) from e

    def run(self, query: str) -> Timed:
        began = time.perf_counter()
        df = self.sql(query)
        planned = time.perf_counter()
        try:
            frame = df.toPandas()
        except Exception as e:
            raise mapped(e) from e
        done = time.perf_counter()
        return Timed(frame, (done - began) * 1000, (done - planned) * 1000)

    def list_tables(self) -> dict:
        return self.catalog.metadata()

    def accelerator_available(self) -> bool:
        """Whether the cluster offers GPUs to this application; queries do not need them."""
        return "gpu" in dict(self.spark.sparkContext.resources)

    def info(self) -> dict:
        """What runs the queries. The fields of an accelerator are null where there is none."""
        sc = self.spark.sparkContext
        gpu = dict(sc.resources).get("gpu")
        return {
            "engine": "Apache Spark", "version": self.spark.version, "master": sc.master, "default_parallelism": sc.defaultParallelism,
            "available": gpu is not None, "name": gpu and ",".join(gpu.addresses), "backend": None, "device_type": "gpu" if gpu else "cpu", "driver": None, "driver_info": None,
        }


_DEFAULT: dict[str, Engine] = {}


def _default(data_path: str | None) -> Engine:
    key = data_path or ""
    if key not in _DEFAULT:
        _DEFAULT[key] = Engine(data_path)
    return _DEFAULT[key]


def execute(query: str, data_path: str | None = None) -> pd.DataFrame:
    """Runs a query over DATA_PATH, or the folder given."""
    return _default(data_path).execute(query)


def list_tables(data_path: str | None = None) -> dict:
    return _default(data_path).list_tables()
