"""Results as text: boxed tables, CSV and notebook bundles."""

from __future__ import annotations

import base64
import html

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

EMPTY = "(empty result)"
ARROW = "application/vnd.apache.arrow.stream"
#: Rows that a notebook shows.
SHOWN = 100


def _cell(x) -> str:
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return ""
    return str(x).replace("\n", "\\n")


def pretty(frame: pd.DataFrame) -> str:
    """A boxed table; numbers to the right; EMPTY without rows."""
    if not len(frame):
        return EMPTY
    names = [str(c) for c in frame.columns]
    columns = [[_cell(x) for x in frame.iloc[:, k].tolist()] for k in range(len(names))]
    right = [pd.api.types.is_numeric_dtype(frame.dtypes.iloc[k]) for k in range(len(names))]
    width = [max(len(n), *map(len, c)) for n, c in zip(names, columns, strict=True)]
    edge = "+" + "+".join("-" * (w + 2) for w in width) + "+"

    def line(cells, align):
        return "|" + "|".join(f" {c.rjust(w) if r else c.ljust(w)} " for c, w, r in zip(cells, width, align, strict=True)) + "|"

    return "\n".join([edge, line(names, [False] * len(names)), edge, *(line(r, right) for r in zip(*columns, strict=True)), edge])


def csv(frame: pd.DataFrame) -> str:
    return frame.to_csv(index=False)


def write_csv(df: DataFrame, path: str) -> None:
    """A large result as CSV files, written by the executors."""
    df.write.mode("overwrite").option("header", True).csv(path)


def mimebundle(df: DataFrame, shown: int = SHOWN) -> dict[str, str]:
    """What a notebook displays: at most `shown` rows as text, HTML and an Arrow stream (base64); only those and one more are computed."""
    table = df.limit(shown + 1).toArrow()
    more = table.num_rows > shown
    table = table.slice(0, shown)
    frame = table.to_pandas()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    text = pretty(frame) + (f"\n... (more than {shown} rows)" if more else "")
    head = "".join(f"<th>{html.escape(str(c))}</th>" for c in frame.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(x))}</td>" for x in row) + "</tr>" for row in frame.itertuples(index=False))
    return {ARROW: base64.b64encode(sink.getvalue()).decode(), "text/plain": text, "text/html": f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>" + (f"<p>more than {shown} rows</p>" if more else "")}
