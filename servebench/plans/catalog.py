"""Registry of named queries: a Spark callable and, where SQL can express it,
the equivalent DuckDB SQL over the same parquet tables.

Each Spark callable takes ``(spark, sf_dir)`` and returns a DataFrame.  Every
query reads the supplied tables (or views Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: register ``fn`` under ``name`` with an optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLE[name] = oracle
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules runs their ``register`` decorators.
    from . import q_analytics, q_wire, q_curate, q_io, q_live  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)


def reset_caches() -> None:
    """Forget materialised stages kept between queries of one session."""
    from . import q_curate

    q_curate._MEMO.clear()
