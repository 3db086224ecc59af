"""Parquet tables by folder or by file, their metadata, and seeded test data."""

from larkframe.sources.catalog import Catalog, Table
from larkframe.sources.generator import generate

__all__ = ["Catalog", "Table", "generate"]
