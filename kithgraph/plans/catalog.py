"""All queries over the photo tables, with their DuckDB forms."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kithgraph.sources.fixtures import Frames, duckdb_views

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("tables", "people", "scores", "vectors", "sequences", "streams", "more", "matching", "albums")

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None, raw: bool = False) -> Callable:
    """Register a function of the view frames; sql continues the views' WITH list unless it is raw."""

    def put(build: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        _queries[name] = lambda spark, sf_dir: build(Frames(spark, sf_dir))
        if sql:
            _oracles[name] = sql if raw else f"{duckdb_views()}\n{sql}"
        return build

    return put


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"kithgraph.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
