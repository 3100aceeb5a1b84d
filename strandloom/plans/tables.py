"""Access to the driver's tables and small shared expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chrom_key(c: Column | str) -> Column:
    """A chromosome name without outer blanks and case."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\n")))


class Registry:
    """Queries and their SQL, filled by decorators."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is defined twice")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return put
