"""Plans as text and JSON, and what kind of query a plan is."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


def logical_text(df: DataFrame, optimized: bool = False) -> str:
    """The analyzed plan, or the optimized one."""
    q = df._jdf.queryExecution()
    return (q.optimizedPlan() if optimized else q.analyzed()).toString()


def physical_text(df: DataFrame) -> str:
    """The physical plan before adaptive changes."""
    return df._jdf.queryExecution().executedPlan().toString()


def plan_json(df: DataFrame) -> list:
    """The optimized logical plan as Catalyst's own JSON (not Substrait)."""
    return json.loads(df._jdf.queryExecution().optimizedPlan().toJSON())


def pushed_filters(df: DataFrame) -> list[str]:
    """The filters that reach each scan."""
    return re.findall(r"PushedFilters: (\[.*?\])", physical_text(df))


@dataclass(frozen=True)
class Kind:
    """What a query mainly does, and why that was said."""

    operation: str
    reason: str


#: Node of the optimized plan, and the operation that it stands for; the first that the plan has names it.
_NODES = (("Window", "Window"), ("Join", "HashJoin"), ("Aggregate", "GroupBy"), ("Filter", "Filter"), ("LogicalRelation", "TableScan"))


def classify(df: DataFrame) -> Kind:
    """One of Aggregation, GroupBy, HashJoin, Filter, TableScan, Window, Complex, Unsupported; for information only."""
    nodes = [n["class"].rsplit(".", 1)[-1] for n in plan_json(df)]
    found = [operation for node, operation in _NODES if node in nodes]
    if not found:
        return Kind("Unsupported", f"no known operator among {', '.join(dict.fromkeys(nodes)) or 'none'}")
    if len([x for x in found if x in ("Window", "HashJoin", "GroupBy")]) > 1:
        return Kind("Complex", f"{' and '.join(x for x in found if x in ('Window', 'HashJoin', 'GroupBy'))} together")
    if found[0] == "GroupBy" and not any(n.get("groupingExpressions") for n in plan_json(df) if n["class"].endswith(".Aggregate")):
        return Kind("Aggregation", "an aggregate without keys")
    return Kind(found[0], f"the plan has {dict((b, a) for a, b in _NODES)[found[0]]}")
