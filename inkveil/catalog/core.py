"""How registered queries get their inputs and their SQL.

Inputs that the tables do not have as such (spreadsheet cells, file records) are derived from them by a
statement in plain SQL that reads the whole table; the SQL of a query starts from the same statement.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from inkveil.session import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


@dataclass
class Source:
    """Tables of one folder, read lazily."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, *columns: str) -> DataFrame:
        """The needed columns of a table of texts, dealt out when it has only a few splits."""
        return spread(self.table(name).select(*columns))

    def derived(self, statement: str) -> DataFrame:
        used = {name for _, name, _, _ in Formatter().parse(statement) if name}
        return self.spark.sql(statement, **{name: self.table(name) for name in used})


def in_sql(statement: str) -> str:
    """The same statement on views that carry the names of the tables."""
    return statement.format_map({name: name for name in TABLES})


@dataclass
class Catalog:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None):
        def register(build: Callable[[Source], DataFrame]):
            self.queries[name] = lambda spark, folder: build(Source(spark, folder))
            if sql:
                self.sql[name] = sql
            return build

        return register


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
