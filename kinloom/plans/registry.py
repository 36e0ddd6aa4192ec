"""All queries of the engine by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from kinloom.plans.views import Inputs, sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Modules that register queries.
_MODULES = ("clusters", "places", "keywords", "expressions", "alignments", "graphs", "scalars", "files", "more", "live", "stored", "folders")


def query(body: str | None = None, *views: str):
    """Registers a function of Inputs under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if body:
            _SQL[f.__name__] = sql(body, *views)
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        import_module(f"kinloom.plans.{m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["t01_ranked_clusters"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
