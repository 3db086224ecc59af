"""Parquet files as tables: discovery, registration and metadata.

Paths are resolved through Spark's file systems, so a folder may be in any store
that the session can read.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from larkframe.errors import ArgumentError, CatalogError

SUFFIX = ".parquet"


@dataclass(frozen=True)
class Table:
    name: str
    path: str


def quoted(name: str) -> str:
    """An identifier as SQL text, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def stem(path: str) -> str:
    """The table name of a file."""
    base = path.rstrip("/").rsplit("/", 1)[-1]
    return base[: -len(SUFFIX)] if base.endswith(SUFFIX) else os.path.splitext(base)[0]


class Catalog:
    """The tables of one session, by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def add_folder(self, folder: str | None = None) -> list[Table]:
        """Registers every `*.parquet` of a folder (default: DATA_PATH, else /opt/data), sorted by name; subfolders are not searched."""
        folder = folder or os.environ.get("DATA_PATH", "/opt/data")
        fs, at = self._fs(folder)
        if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
            raise CatalogError(f"cannot read the data folder {folder}", -2)
        found = sorted(s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().endswith(SUFFIX))
        if not found:
            raise CatalogError(f"no Parquet files in {folder}", -3)
        return [self.add(stem(p), p) for p in found]

    def add_files(self, files: list[str], names: list[str] | None = None) -> list[Table]:
        """Registers files under the names given, or their stems. Counts must match, files must exist, names must differ."""
        if names and len(names) != len(files):
            raise ArgumentError(f"{len(names)} table names for {len(files)} files")
        names = names or [stem(f) for f in files]
        if len({n.lower() for n in names}) != len(names):
            raise ArgumentError("two files have the same table name; give names")
        for f in files:
            fs, at = self._fs(f)
            if not fs.exists(at):
                raise ArgumentError(f"file not found: {f}")
        return [self.add(n, f) for n, f in zip(names, files, strict=True)]

    def add(self, name: str, path: str) -> Table:
        """Registers one file or folder of files as a view. Views only: nothing is read until a query runs."""
        self.spark.read.parquet(path).createOrReplaceTempView(quoted(name))
        table = self.tables[name] = Table(name, path)
        return table

    def frame(self, name: str) -> DataFrame:
        return self.spark.table(quoted(name))

    def metadata(self) -> dict:
        """{"tables": [{name, file_path, num_rows, file_size_bytes, columns: [{name, data_type, nullable}]}]}.

        Row counts and nullability come from the Parquet footers; no query runs.
        """
        return {"tables": [self._one(t) for t in self.tables.values()]}

    def _one(self, table: Table) -> dict:
        rows, size, nullable = 0, 0, {}
        for path, length in self._files(table.path):
            size += length
            n, fields = self._footer(path)
            rows += n
            nullable = nullable or fields
        schema = self.spark.table(quoted(table.name)).schema
        columns = [{"name": f.name, "data_type": f.dataType.simpleString(), "nullable": nullable.get(f.name, f.nullable)} for f in schema.fields]
        return {"name": table.name, "file_path": table.path, "num_rows": rows, "file_size_bytes": size, "columns": columns}

    def _files(self, path: str) -> list[tuple[str, int]]:
        fs, at = self._fs(path)
        status = fs.getFileStatus(at)
        if not status.isDirectory():
            return [(path, status.getLen())]
        out: list[tuple[str, int]] = []
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if not name.startswith(("_", ".")):
                out += self._files(s.getPath().toString()) if s.isDirectory() else [(s.getPath().toString(), s.getLen())]
        return out

    def _footer(self, path: str) -> tuple[int, dict[str, bool]]:
        """Rows and nullable columns of one file, by the Parquet reader that Spark ships."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            fields = reader.getFooter().getFileMetaData().getSchema().getFields()
            return reader.getRecordCount(), {f.getName(): f.getRepetition().toString() != "REQUIRED" for f in fields}
        finally:
            reader.close()
