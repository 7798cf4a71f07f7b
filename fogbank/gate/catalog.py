"""Registry of the queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fogbank.gate.views import CODE, EV, FC, LB, NM, OB, PR, SC

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VIEWS = {"ev": EV, "lb": LB, "ob": OB, "sc": SC, "pr": PR, "nm": NM, "fc": FC}
NEEDS = {"lb": ["ev"], "ob": ["ev"], "sc": ["ev"], "pr": ["ev", "sc"], "fc": ["ev"]}


def with_views(names: str, body: str) -> str:
    """``body`` after the named views; a body that starts with a name adds its own."""
    order: list[str] = []
    for name in names.split():
        for v in [*NEEDS.get(name, []), name]:
            if v not in order:
                order.append(v)
    parts = [VIEWS[v] for v in order]
    body = body.strip()
    if body.startswith("+"):
        return "WITH " + ", ".join(parts) + ", " + body[1:].strip()
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def query(name: str, views: str = "", sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn
    return register


__all__ = ["CODE", "ORACLES", "QUERIES", "query", "with_views"]
