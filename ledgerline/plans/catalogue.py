"""The registered queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from ledgerline.plans import catalog_queries, graph_queries, ledger_queries, reconcile_queries, sequence_queries, text_queries  # noqa: F401


def query(name: str, sql: str | None = None):
    """Register the decorated (spark, sf_dir) function, with its SQL if there is any. Decimals come out as doubles, so
    that results compare alike whatever reads them."""

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
            return out.withColumns({c: F.col(c).cast("double") for c, t in out.dtypes if t.startswith("decimal")})

        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return fn

    return keep
