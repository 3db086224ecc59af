"""Error classes of the service layer and the mapping from Spark's errors."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException, PySparkException


class EngineError(RuntimeError):
    """Base of all errors; `code` is the numeric code of the error class."""

    code = -5


class ArgumentError(EngineError):
    """A value that cannot be used: names and files that do not match, text that is no UTF-8."""

    code = -1


class CatalogError(EngineError):
    """The data folder cannot be read (-2) or holds no Parquet file (-3)."""

    code = -2

    def __init__(self, message: str, code: int = -2):
        super().__init__(message)
        self.code = code


class SqlError(EngineError):
    """A statement that failed; the message begins with the code."""

    def __init__(self, message: str):
        super().__init__(f"SQL Error (code {self.code}): {message}")


class ParseError(SqlError):
    """The statement could not be parsed."""


class TableError(SqlError):
    """An unknown table."""


class ColumnError(SqlError):
    """An unknown or ambiguous column."""


class ExecutionError(SqlError):
    """The statement failed while it ran."""


def mapped(error: BaseException) -> EngineError:
    """The engine's error for an error of Spark."""
    if isinstance(error, EngineError):
        return error
    text = str(error).strip() or type(error).__name__
    name = (error.getCondition() or "") if isinstance(error, PySparkException) else ""
    if isinstance(error, ParseException):
        return ParseError(f"cannot parse the statement: {text}")
    if name.startswith("TABLE_OR_VIEW_NOT_FOUND"):
        return TableError(f"unknown table: {text}")
    if name.startswith(("UNRESOLVED_COLUMN", "AMBIGUOUS_REFERENCE", "MISSING_AGGREGATION")):
        return ColumnError(f"unknown or ambiguous column: {text}")
    if isinstance(error, AnalysisException):
        return SqlError(f"cannot plan the statement: {text}")
    return ExecutionError(f"Query execution failed: {text}")
