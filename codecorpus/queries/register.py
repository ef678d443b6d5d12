"""How a module of queries names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from codecorpus.queries.views import frame, oracle


def adder(into: dict) -> Callable:
    """add(name, views, function of their DataFrames, SQL or None)."""

    def add(name: str, views: str, run: Callable[..., DataFrame], sql: str | None) -> None:
        def query(spark, sf_dir, run=run, views=views.split()):
            return run(*[frame(spark, sf_dir, v) for v in views])

        query.__name__ = name
        into[name] = (query, oracle(sql) if sql else None)

    return add
