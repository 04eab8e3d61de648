"""Tables of a directory as views, and queries of any dialect over them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..functions.udfs import register
from .lexer import tokens
from .spark_sql import translate

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Engine:
    """A directory of Parquet tables; only the tables that a query names are opened."""

    def __init__(self, spark: SparkSession, directory: str, tables: Iterable[str] = TABLES):
        self.spark, self.directory, self.tables = spark, directory, set(tables)
        self.extra: dict[str, DataFrame] = {}
        self.opened: dict[str, DataFrame] = {}
        self.keys: dict[str, list[str]] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = self.extra[name] if name in self.extra else self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        return self.opened[name]

    def add(self, name: str, df: DataFrame, key: list[str] | None = None) -> Engine:
        """A table of the engine's own; its key, where one is given or declared, is what ON DUPLICATE KEY goes by."""
        self.extra[name] = df
        if key:
            self.keys[name] = key
        self.opened.pop(name, None)
        return self

    def key(self, name: str) -> list[str]:
        """The primary key of a table, as given to add or declared in its schema; none where neither is."""
        return self.keys.get(name) or [f.name for f in self.table(name).schema if (f.metadata or {}).get("primary_key")]

    def isolated(self) -> Engine:
        """An engine over the same folder in a session of its own: settings, views and functions of one don't reach the other. Tables that were added stay behind, as they belong to their session."""
        return Engine(self.spark.newSession(), self.directory, self.tables)

    def catalog(self, sql: str, dialect: str) -> dict[str, dict[str, str]]:
        """Column types of the tables that sql names; each becomes a view."""
        words = {t.text.lower() for t in tokens(sql, dialect) if t.kind in ("word", "quoted")}
        out = {}
        for name in sorted(words & (self.tables | set(self.extra))):
            df = self.table(name)
            df.createOrReplaceTempView(name)
            out[name] = {f.name: f.dataType.simpleString() for f in df.schema}
        return out

    def spark_sql(self, sql: str, dialect: str) -> str:
        return translate(sql, dialect, self.catalog(sql, dialect))

    def run(self, sql: str, dialect: str) -> DataFrame:
        return self.run_spark_sql(self.spark_sql(sql, dialect))

    def run_spark_sql(self, text: str) -> DataFrame:
        if "tessella_" in text:
            register(self.spark)
        return self.spark.sql(text)

    def compiles(self, sql: str, dialect: str) -> tuple[bool, str]:
        """Whether Spark can plan the query, and why not; nothing is executed."""
        try:
            self.run(sql, dialect)
        except Exception as e:  # whatever the parser or the analyser says is the answer
            return False, str(e).split("\n")[0]
        return True, ""

    def result_types(self, sql: str, dialect: str) -> list[tuple[str, str]]:
        """Column names in lower case and types, by analysis alone."""
        return [(f.name.lower(), f.dataType.simpleString()) for f in self.run(sql, dialect).schema]
