"""Registration: a name, a Spark query over the whole tables, and (where SQL can say it) its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `views` are the model tables its SQL needs."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            names = views.split()
            body = sql.strip()
            if names and body.lower().startswith("with recursive"):
                ORACLES[name] = with_views(*names).replace("with ", "with recursive ", 1).rstrip() + ", " + body[len("with recursive"):].lstrip()
            elif names and body.lower().startswith("with "):
                ORACLES[name] = with_views(*names).rstrip() + ", " + body[len("with "):].lstrip()
            else:
                ORACLES[name] = (with_views(*names) if names else "") + body
        return fn

    return add


def r6(col: str | Column, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6).alias(name or col)
