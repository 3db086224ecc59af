"""Scalar functions under the names that users of other SQL engines know."""

from larkframe.functions.names import FUNCTIONS, register

__all__ = ["FUNCTIONS", "register"]
