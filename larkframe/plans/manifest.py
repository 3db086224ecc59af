"""A query with its tables and plan as one JSON document that can be read and run again."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from larkframe.errors import ArgumentError
from larkframe.plans.inspect import plan_json
from larkframe.sources.catalog import Catalog

VERSION = "1.0"


@dataclass
class Manifest:
    sql: str
    tables: dict[str, dict] = field(default_factory=dict)
    plan: list = field(default_factory=list)
    version: str = VERSION
    plan_format: str = "catalyst-json"

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        got = json.loads(text)
        if got.get("version") != VERSION:
            raise ArgumentError(f"manifest version {got.get('version')!r} is not {VERSION}")
        return cls(**got)


def export(catalog: Catalog, sql: str, path: str | None = None, schema: bool = True) -> Manifest:
    """The manifest of a query over a catalog's tables; written to `path` if one is given."""
    df = catalog.spark.sql(sql)
    tables = {}
    for t in catalog.tables.values():
        entry: dict = {"path": t.path if "://" in t.path or t.path.startswith("file:") else str(Path(t.path).resolve()), "format": "parquet"}
        if schema:
            entry["schema"] = [{"name": f.name, "data_type": f.dataType.simpleString()} for f in catalog.frame(t.name).schema.fields]
        tables[t.name] = entry
    made = Manifest(sql, tables, plan_json(df))
    if path:
        Path(path).write_text(made.to_json())
    return made


def read(path: str) -> Manifest:
    return Manifest.from_json(Path(path).read_text())


def replay(catalog: Catalog, manifest: Manifest) -> DataFrame:
    """Registers the manifest's tables and plans its query again."""
    for name, entry in manifest.tables.items():
        if entry["format"] != "parquet":
            raise ArgumentError(f"table {name} has format {entry['format']!r}; only parquet is read")
        catalog.add(name, entry["path"])
    return catalog.spark.sql(manifest.sql)
