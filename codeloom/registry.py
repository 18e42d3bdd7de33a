"""Where queries register: what runs them, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators.graph import SQL, Graph, load

Runner = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def behind_graph(sql: str) -> str:
    """SQL behind the graph's common table expressions; a leading + says that it begins with more of them."""
    return f"WITH RECURSIVE {SQL.strip()}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"


def on_graph(sql: str | None = None) -> Callable[[Callable[[Graph], DataFrame]], Callable[[Graph], DataFrame]]:
    """Registers a query on the graph of the warehouse tables. sql: behind the graph's common table expressions."""

    def register(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(load(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = behind_graph(sql)
        return f

    return register


def on_both(sql: str | None = None) -> Callable[[Callable[[Graph, SparkSession, str], DataFrame]], Callable[[Graph, SparkSession, str], DataFrame]]:
    """Registers a query on the graph and on tables beside it."""

    def register(f: Callable[[Graph, SparkSession, str], DataFrame]) -> Callable[[Graph, SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(load(spark, sf_dir), spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = behind_graph(sql)
        return f

    return register


def on_tables(sql: str | None = None) -> Callable[[Runner], Runner]:
    """Registers a query on the tables themselves."""

    def register(f: Runner) -> Runner:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
