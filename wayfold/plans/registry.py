"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import scenario

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Inputs:
    """The scenario relations of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return scenario.relation(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, needs: str = "") -> Callable:
    """Register a function of Inputs. sql goes behind a WITH clause of the relations it needs."""

    def keep(make: Callable[[Inputs], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: make(Inputs(spark, sf_dir))
        if sql is not None:
            head = scenario.sql_with(*needs.split())
            body = sql.strip()
            SQL[name] = f"{head},\n{body[1:]}" if body.startswith(",") else f"{head}\n{body}"
        return make

    return keep
