"""Spark-native semantic query and claim-verification engine."""

from veracord.frame import QueryResult, SemanticFrame
from veracord.plans.expr import Expr, bool_and, bool_or, col, count_if, lit, native, prompt, proportion
from veracord.plans.schema import Field, Row, Schema
from veracord.session import Session

__all__ = ["Expr", "Field", "QueryResult", "Row", "Schema", "SemanticFrame", "Session", "bool_and", "bool_or", "col", "count_if", "lit", "native", "prompt", "proportion"]
