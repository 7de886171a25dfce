"""Named queries: a Spark callable and, where it can be said in SQL, the equivalent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockloom.session import prepare
from blockloom.sources.driver_model import DriverModel, sql_over

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, over: tuple[str, ...] = ()):
    """Register `build(model)` under a name; `over` lists the model tables the SQL reads."""

    def register(build: Callable[[DriverModel], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return build(DriverModel(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql_over(sql, *over) if over else sql.strip()
        return build

    return register
