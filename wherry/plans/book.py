"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """The queries and SQL of one module."""

    def __init__(self, common: str = "") -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.common = common

    def add(self, sql: str | None = None, common: bool = True) -> Callable[[Query], Query]:
        """Registers a function under its own name; ``sql`` follows the module's common table expressions."""

        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                lead = self.common if common else ""
                body = sql.strip()
                if lead and body.upper().startswith("WITH "):
                    body = ", " + body[5:]
                self.sql[f.__name__] = lead + "\n" + body
            return f

        return put
