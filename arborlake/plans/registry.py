"""Every registered query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import access_queries, diff_queries, registry_queries, sink_queries, stored_queries, tree_queries

_MODULES = [tree_queries, diff_queries, access_queries, registry_queries, sink_queries, stored_queries]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: roll up the object listing and show directories by size."""
    return tree_queries.tree_rollup(spark, sf_dir).where("kind = 'dir'").orderBy("depth", "path")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q[0] for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for m in _MODULES for name, q in m.QUERIES.items() if q[1]}
