"""Registry of named queries: a Spark plan and the DuckDB oracle SQL for each key.

Every Spark plan reads the whole driver tables through the annotation mapping;
every oracle states the same rule as SQL of its own structure over the same mapping
views, so the check compares two independent formulations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.mapping import annotation_tables, with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    """Decorator: ``fn(t, spark, sf_dir)`` -> DataFrame, where ``t`` holds the
    annotation tables.  ``oracle`` is SQL over the ``ann_*`` views (None = no
    SQL form; the driver then checks row counts only)."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(annotation_tables(spark, sf_dir), spark, sf_dir)

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = with_views(oracle)
        return fn

    return deco


def all_queries() -> dict[str, QueryFn]:
    from . import queries  # noqa: F401  (fills the registry)
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    from . import queries  # noqa: F401
    return dict(ORACLES)
