"""Spark-native knowledge graphs: build, query, measure, reason over and store property graphs."""

from graphwright.operators.graph import KG

__all__ = ["KG"]
