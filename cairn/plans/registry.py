"""All registered queries, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.plans import bundle, changes, fixture, more, sources  # noqa: F401  (they add to the same tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(fixture.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(fixture.ORACLES)
