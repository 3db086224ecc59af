"""Looking at plans, and exporting a query with its tables and plan."""

from larkframe.plans.inspect import Kind, classify, logical_text, physical_text, plan_json, pushed_filters
from larkframe.plans.manifest import Manifest, export, read, replay

__all__ = ["Kind", "Manifest", "classify", "export", "logical_text", "physical_text", "plan_json", "pushed_filters", "read", "replay"]
