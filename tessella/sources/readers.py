"""Readers and writers of the table formats: header-row JSON, pipe-separated text, CSV, INSERT scripts and DDL."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lexer import SqlError, split_arguments, split_statements, tokens
from ..plans.parser import Parser
from ..plans.spark_sql import spark_type

# Bytes of one INSERT statement by dialect.
BATCH_BYTES = {"mysql": 4000, "pg": 50_000, "oracle": 40_000}


@dataclass
class Column:
    name: str
    type: str  # of Spark
    nullable: bool = True
    values: list[str] = field(default_factory=list)  # of an ENUM


@dataclass
class Table:
    """A declared table with its constraints."""

    name: str
    columns: list[Column]
    primary_key: list[str] = field(default_factory=list)
    foreign_keys: list[tuple[list[str], str, list[str]]] = field(default_factory=list)
    indexes: list[list[str]] = field(default_factory=list)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, T.StructType.fromDDL(f"x {c.type}")[0].dataType, c.nullable, {"primary_key": c.name in self.primary_key, "values": c.values}) for c in self.columns])

    def to_json(self) -> str:
        return json.dumps(
            {
                "table": self.name,
                "primary_key": self.primary_key,
                "cols": [{"col_name": c.name, "type": {"type_name": c.type.upper(), **({"values": c.values} if c.values else {})}, "attribute": [] if c.nullable else ["NOT NULL"]} for c in self.columns],
                "foreign_key": [{"col": a, "ref_table": t, "ref_col": b} for a, t, b in self.foreign_keys],
                "index": self.indexes,
            }
        )

    @staticmethod
    def from_json(text: str) -> Table:
        d = json.loads(text)
        many = lambda x: [x] if isinstance(x, str) else list(x)
        cols = [Column(c["col_name"], declared_type(c["type"]), "NOT NULL" not in [a.upper() for a in c.get("attribute", [])], c["type"].get("values", [])) for c in d["cols"]]
        return Table(d["table"], cols, many(d.get("primary_key", [])), [(many(f["col"]), f["ref_table"], many(f["ref_col"])) for f in d.get("foreign_key", [])], d.get("index", []))

    def renamed(self, old: str, new: str) -> Table:
        """The table after another one, or itself, has a new name: references follow."""
        return Table(new if self.name == old else self.name, self.columns, self.primary_key, [(a, new if t == old else t, b) for a, t, b in self.foreign_keys], self.indexes)

    def with_column_renamed(self, old: str, new: str) -> Table:
        to = lambda cs: [new if c == old else c for c in cs]
        return Table(self.name, [Column(new if c.name == old else c.name, c.type, c.nullable, c.values) for c in self.columns], to(self.primary_key), [(to(a), t, to(b) if t == self.name else b) for a, t, b in self.foreign_keys], [to(i) for i in self.indexes])

    def ddl(self, dialect: str) -> str:
        """CREATE TABLE in a dialect."""
        quote = "`{}`" if dialect == "mysql" else '"{}"'
        lines = []
        for c in self.columns:
            lines.append(f"  {quote.format(c.name)} {dialect_type(c.type, dialect)}{'' if c.nullable else ' NOT NULL'}" + (f" CHECK ({quote.format(c.name)} IN ({', '.join(repr(v) for v in c.values)}))" if c.values else ""))
        if self.primary_key:
            lines.append(f"  PRIMARY KEY ({', '.join(quote.format(c) for c in self.primary_key)})")
        return f"CREATE TABLE {quote.format(self.name)} (\n" + ",\n".join(lines) + "\n)"

    def foreign_key_ddl(self, dialect: str) -> list[str]:
        quote = "`{}`" if dialect == "mysql" else '"{}"'
        names = lambda cs: ", ".join(quote.format(c) for c in cs)
        cascade = "" if dialect == "oracle" else " ON DELETE CASCADE"
        return [f"ALTER TABLE {quote.format(self.name)} ADD FOREIGN KEY ({names(a)}) REFERENCES {quote.format(t)} ({names(b)}){cascade}" for a, t, b in self.foreign_keys]


# Declared type names.
DECLARED = {
    "INT": "int", "BIGINT": "bigint", "BOOL": "boolean", "DOUBLE": "double", "FLOAT": "float", "DATE": "date", "TIME": "string", "YEAR": "int", "TIMESTAMP": "timestamp_ntz", "DATETIME": "timestamp_ntz", "TIMESTAMPTZ": "timestamp",
    "VARCHAR": "string", "NVARCHAR": "string", "CHAR": "string", "TEXT": "string", "ENUM": "string", "UUID": "string", "JSON": "string", "JSONB": "string", "XML": "string", "BLOB": "binary", "POINT": "struct<lon:double,lat:double>", "INTERVAL YEAR TO MONTH": "interval year to month",
}
PRINTED = {
    "mysql": {"int": "INT", "bigint": "BIGINT", "boolean": "TINYINT(1)", "double": "DOUBLE", "float": "FLOAT", "date": "DATE", "timestamp_ntz": "DATETIME(6)", "timestamp": "TIMESTAMP(6)", "string": "TEXT", "binary": "BLOB"},
    "pg": {"int": "INT", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE PRECISION", "float": "REAL", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMPTZ", "string": "TEXT", "binary": "BYTEA"},
    "oracle": {"int": "NUMBER(10)", "bigint": "NUMBER(19)", "boolean": "NUMBER(1)", "double": "BINARY_DOUBLE", "float": "BINARY_FLOAT", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "string": "VARCHAR2(4000)", "binary": "BLOB"},
}


def declared_type(t: dict) -> str:
    name = t["type_name"].upper()
    if name == "DECIMAL":
        return f"decimal({t.get('precision', 10)},{t.get('scale', 0)})"
    if name == "ARRAY":
        return f"array<{declared_type(t['ele_type'])}>"
    return DECLARED.get(name, name.lower())


def dialect_type(t: str, dialect: str) -> str:
    if t.startswith("decimal"):
        return ("NUMBER" if dialect == "oracle" else "DECIMAL") + t[7:]
    return PRINTED[dialect].get(t, t.upper())


def parse_ddl(sql: str, dialect: str) -> Table:
    """A table from CREATE TABLE: columns with types, NOT NULL and ENUM values, keys and references."""
    p = Parser(tokens(sql, dialect), dialect)
    p.need("CREATE")
    while not p.take("TABLE"):
        p.next()
    p.take("IF", "NOT", "EXISTS")
    table = Table(p.dotted()[-1].text, [])
    p.need("(")
    while True:
        if p.take("CONSTRAINT"):
            p.name()
        if p.take("PRIMARY", "KEY"):
            table.primary_key = [n.text for n in p.names()]
        elif p.take("FOREIGN", "KEY"):
            cols = [n.text for n in p.names()]
            p.need("REFERENCES")
            to = p.dotted()[-1].text
            table.foreign_keys.append((cols, to, [n.text for n in p.names()] if p.at("(") else []))
        elif p.take("UNIQUE") or p.take("KEY") or p.take("INDEX"):
            p.take("KEY") or p.take("INDEX")
            if not p.at("("):
                p.name()
            table.indexes.append([n.text for n in p.names()])
        elif p.take("CHECK"):
            _skip(p)
        else:
            name = p.name().text
            if p.take("ENUM"):
                values = [v.text for v in _strings(p)]
                column = Column(name, "string", True, values)
            else:
                column = Column(name, spark_type(p.type(), dialect))
            while not (p.at(",") or p.at(")")):
                if p.take("NOT", "NULL"):
                    column.nullable = False
                elif p.take("PRIMARY", "KEY"):
                    table.primary_key = [name]
                elif p.take("REFERENCES"):
                    to = p.dotted()[-1].text
                    table.foreign_keys.append(([name], to, [n.text for n in p.names()] if p.at("(") else []))
                elif p.at("("):
                    _skip(p)
                elif p.now.kind == "end":
                    raise SqlError("CREATE TABLE isn't closed")
                else:
                    p.next()
            table.columns.append(column)
        while p.now.is_("ON", "DELETE", "CASCADE", "UPDATE", "SET", "NULL"):
            p.next()
        if not p.take(","):
            break
    p.need(")")
    return table


def _skip(p: Parser) -> None:
    p.need("(")
    depth = 1
    while depth:
        depth += {"(": 1, ")": -1}.get(p.next().text, 0)


def _strings(p: Parser) -> list:
    p.need("(")
    out = [p.next()]
    while p.take(","):
        out.append(p.next())
    p.need(")")
    return out


def cell_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of text as the declared types; an empty text is null, and what can't be read is an error."""
    return df.select(*[F.nullif(F.col(f.name), F.lit("")).cast(f.dataType).alias(f.name) for f in schema])


def read_json_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An array of arrays of which the first is the header; columns come in the order of schema. Typed cells are objects with a value."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("t"))
    header = F.transform(F.get("t", F.lit(0)), lambda h: F.lower(h))
    rows = whole.select(header.alias("h"), F.explode(F.slice("t", 2, F.size("t"))).alias("r"))

    def cell(name: str):
        raw = F.get("r", (F.array_position("h", name.lower()) - 1).cast("int"))
        return F.when(raw.startswith("{"), F.get_json_object(raw, "$.value")).otherwise(raw)

    return typed(rows.select(*[cell(f.name).alias(f.name) for f in schema]), schema)


def read_pipe(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Pipe-separated ISO-8859-1 text; an empty field is null; a line of another number of fields is an error."""
    lines = spark.read.option("encoding", "ISO-8859-1").csv(path, sep="\u0001", schema="line string", quote="")
    n = len(schema)
    parts = lines.select(F.split("line", r"\|", -1).alias("p"))
    closing = (F.size("p") == n + 1) & (F.get("p", F.lit(n)) == "")  # a line may end with a separator
    parts = parts.select(F.when(closing, F.slice("p", 1, n)).otherwise(F.col("p")).alias("p"))
    checked = parts.withColumn("p", F.when(F.size("p") == n, F.col("p")).otherwise(F.raise_error(F.concat(F.lit(f"a line has not {n} fields but "), F.size("p").cast("string")))))
    return typed(checked.select(*[F.get("p", F.lit(k)).alias(f.name) for k, f in enumerate(schema)]), schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; without a schema all columns are text."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return raw if schema is None else typed(raw.select(*[f.name for f in schema]), schema)


def parse_insert(sql: str, dialect: str) -> tuple[str, list[str], list[list]]:
    """(table, columns, rows) of an INSERT statement with literal values."""
    p = Parser(tokens(sql, dialect), dialect)
    p.need("INSERT")
    p.take("IGNORE")
    p.need("INTO")
    table = p.dotted()[-1].text
    cols = [n.text for n in p.names()] if p.at("(") else []
    p.need("VALUES")
    rows = [[_literal(e) for e in row] for row in p.list(p.values_row)]
    return table, cols, rows


def _literal(e):
    if e.kind == "null":
        return None
    if e.kind in ("string", "number", "typed"):
        return e.text
    if e.kind == "bool":
        return str(e.value).lower()
    if e.kind == "unary" and e.expr.kind == "number":
        return e.op + e.expr.text
    if e.kind == "call" and e.args:  # TO_DATE('…', '…') and the like stand for their text
        return _literal(e.args[0])
    if e.kind == "cast":
        return _literal(e.expr)
    raise SqlError(f"no literal: {e!r}")


def read_inserts(spark: SparkSession, script: str, dialect: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Tables from the INSERT statements of a script."""
    rows: dict[str, list] = {}
    for statement in split_statements(script, dialect):
        if re.match(r"\s*INSERT\b", statement, re.I):
            table, cols, values = parse_insert(statement, dialect)
            schema = schemas[table]
            at = [[c.lower() for c in cols or schema.names].index(f.name.lower()) if f.name.lower() in [c.lower() for c in cols or schema.names] else None for f in schema]
            rows.setdefault(table, []).extend(tuple(v[k] if k is not None else None for k in at) for v in values)
    return {t: typed(spark.createDataFrame(r, cell_text(schemas[t])), schemas[t]) for t, r in rows.items()}


def insert_statements(table: str, rows: list[tuple], dialect: str) -> list[str]:
    """INSERT statements of literal rows, none longer than the dialect's limit unless one row is."""
    head, out, now = f"INSERT INTO {table} VALUES ", [], []
    for r in rows:
        text = "(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'" for v in r) + ")"
        if now and (dialect == "oracle" or len(head) + sum(map(len, now)) + 2 * len(now) + len(text) > BATCH_BYTES[dialect]):
            out.append(head + ", ".join(now))
            now = []
        now.append(text)
    return [*out, head + ", ".join(now)] if now else out


def index_ddl(t: Table, dialect: str) -> list[str]:
    quote = "`{}`" if dialect == "mysql" else '"{}"'
    return [f"CREATE INDEX {quote.format(f'idx_{t.name}_{k}')} ON {quote.format(t.name)} ({', '.join(quote.format(c) for c in cols)})" for k, cols in enumerate(t.indexes)]


def dump_schema(tables: list[Table], dialect: str) -> dict[str, list[str]]:
    """The statements that make the tables, their references and their indexes, in three parts."""
    return {"ddl": [t.ddl(dialect) for t in tables], "fk": [s for t in tables for s in t.foreign_key_ddl(dialect)], "idx": [s for t in tables for s in index_ddl(t, dialect)]}


def build_database(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> None:
    """A database of the session's catalog with these tables, in place of one of that name."""
    drop_database(spark, name)
    spark.sql(f"CREATE DATABASE `{name}`")
    for t, df in tables.items():
        df.write.saveAsTable(f"`{name}`.`{t}`", format="parquet")


def drop_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")


def catalog_tables(spark: SparkSession, name: str) -> dict[str, Table]:
    """The tables of a database as declared tables, by name."""
    out = {}
    for t in sorted(spark.catalog.listTables(name), key=lambda t: t.name):
        if not t.isTemporary:
            out[t.name] = Table(t.name, [Column(f.name, f.dataType.simpleString(), f.nullable) for f in spark.table(f"`{name}`.`{t.name}`").schema])
    return out


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


__all__ = ["Column", "Table", "parse_ddl", "read_json_table", "read_pipe", "read_csv", "parse_insert", "read_inserts", "insert_statements", "index_ddl", "dump_schema", "build_database", "drop_database", "catalog_tables", "append", "split_arguments", "split_statements"]
