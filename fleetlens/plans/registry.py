"""Queries and the SQL that says the same, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.sources.telemetry import VIEW

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; `tel` in its SQL is the telemetry view of the events table, `o` its order in a vehicle."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            recursive = "RECURSIVE " if body.startswith("WITH RECURSIVE ") else ""
            body = body.removeprefix("WITH ").removeprefix(recursive)
            text = f"WITH {recursive}tel AS ({VIEW}), {body}" if sql.strip().startswith("WITH ") else f"WITH tel AS ({VIEW}) {body}" if "tel" in sql else body
            ORACLES[name] = text.replace("{o}", "PARTITION BY id ORDER BY t_sec, sequence").replace("{up}", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW").replace("{down}", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")
        return f

    return put
