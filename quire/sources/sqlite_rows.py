"""Tables of SQLite files as a Spark data source, read-only and in parallel; no driver jar is needed.

    spark.dataSource.register(SqliteRows)
    spark.read.format("sqlite_rows").option("table", "snippets").load("/shared/runs/*/corrections.db")

Files are opened with mode=ro, so nothing is ever written, a journal or a missing file included. A file's rows are cut into
ranges of rowids, a partition each; a table without rowids is one partition a file. Comparisons, IN and null tests are
evaluated in SQLite; only the columns of the schema are read, so .schema("id bigint, text string") prunes. All files that
the path names are read as one table; columns that a file lacks are null in its rows. The option `tag` adds the name of
the folder that a file is in as a column of that name.

SQLite types values, not columns. A value is given if it is of the kind that the column is declared as (whole numbers are
reals too) and is null otherwise; filters see the same. Texts compare by bytes whatever collation is declared.
"""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS_A_PARTITION = 200_000
ROWS_A_BATCH = 10_000
#: Kinds of values that a column of each type takes.
KINDS = {"bigint": ("integer",), "double": ("real", "integer"), "string": ("text",), "binary": ("blob",)}
COMPARED = {D.EqualTo: "=", D.EqualNullSafe: "IS", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True)


def named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def type_of(declared: str) -> T.DataType:
    """The affinity that SQLite gives to a declared type."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in d or not d:
        return T.BinaryType()
    return T.DoubleType()


def columns_of(path: str, table: str) -> dict[str, T.DataType]:
    with closing(opened(path)) as db:
        return {name: type_of(kind or "") for _, name, kind, *_ in db.execute(f"PRAGMA table_info({named(table)})")}


@dataclass
class Range(D.InputPartition):
    path: str
    first: int | None = None
    last: int | None = None


class SqliteRows(D.DataSource):
    """See the module's text. Options: path, table, rows (of a partition), tag."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def files(self) -> list[str]:
        path = self.options["path"].removeprefix("file://")
        found = sorted(glob.glob(path)) if not os.path.isfile(path) else [path]
        if not found:
            raise FileNotFoundError(path)
        return found

    def schema(self) -> T.StructType:
        every: dict[str, T.DataType] = {}
        for f in self.files():
            for name, kind in columns_of(f, self.options["table"]).items():
                every.setdefault(name, kind)
        if not every:
            raise ValueError(f"no table {self.options['table']!r}")
        tag = self.options.get("tag")
        return T.StructType([T.StructField(n, t) for n, t in (every | ({tag: T.StringType()} if tag else {})).items()])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, self.files(), self.options["table"], self.options.get("tag"), int(self.options.get("rows", ROWS_A_PARTITION)))


class SqliteReader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, files: list[str], table: str, tag: str | None, rows: int) -> None:
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        for name, kind in self.fields:
            if kind not in KINDS:
                raise ValueError(f"{name}: a column can be {', '.join(KINDS)}, not {kind}")
        self.schema, self.files, self.table, self.tag, self.rows = schema, files, table, tag, rows
        self.conditions: list[tuple[str, str, list]] = []  # (column, SQL, values)

    def _value(self, name: str) -> str:
        """A column's value as the schema has it."""
        kinds = ", ".join(f"'{k}'" for k in KINDS[dict(self.fields)[name]])
        return f"CASE WHEN typeof({named(name)}) IN ({kinds}) THEN {named(name)} END"

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            negated, plain = (True, f.child) if isinstance(f, D.Not) else (False, f)
            name = plain.attribute[0] if hasattr(plain, "attribute") and len(plain.attribute) == 1 else None
            value = getattr(plain, "value", None)
            if name == self.tag or name not in dict(self.fields) or isinstance(value, (bool, float)) and value != value:
                yield f
                continue
            v, own = f"({self._value(name)}) COLLATE BINARY", None
            if type(plain) in COMPARED and isinstance(value, (int, float, str, bytes)) and not isinstance(value, bool):
                own = (f"{v} {COMPARED[type(plain)]} ?", [value])
            elif isinstance(plain, D.In) and all(isinstance(x, (int, float, str, bytes)) and not isinstance(x, bool) for x in plain.value) and len(plain.value) < 500:
                own = (f"{v} IN ({', '.join('?' * len(plain.value))})", list(plain.value))
            elif isinstance(plain, D.IsNull):
                own = (f"{v} IS NULL", [])
            elif isinstance(plain, D.IsNotNull):
                own = (f"{v} IS NOT NULL", [])
            if own is None:
                yield f
            else:
                self.conditions.append((name, f"NOT ({own[0]})" if negated else own[0], own[1]))

    def partitions(self) -> list[Range]:
        out = []
        for path in self.files:
            with closing(opened(path)) as db:
                try:
                    first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {named(self.table)}").fetchone()
                except sqlite3.OperationalError:  # no such table here, or one without rowids
                    if columns_of(path, self.table):
                        out.append(Range(path))
                    continue
            if first is not None:
                out += [Range(path, at, min(at + self.rows - 1, last)) for at in range(first, last + 1, self.rows)]
        return out or [Range("")]  # Spark wants one at least

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        held = set(columns_of(partition.path, self.table))
        picked = ", ".join(self._value(n) if n in held and n != self.tag else "NULL" for n, _ in self.fields) or "NULL"
        where, values = ["1"], []
        for name, sql, own in self.conditions:
            if name in held:
                where.append(sql)
            else:  # a column that this file lacks is null
                where.append(sql.replace(f"({self._value(name)}) COLLATE BINARY", "NULL"))
            values += own
        if partition.first is not None:
            where.append("rowid BETWEEN ? AND ?")
            values += [partition.first, partition.last]
        arrow = to_arrow_schema(self.schema)
        folder = os.path.basename(os.path.dirname(os.path.abspath(partition.path)))
        with closing(opened(partition.path)) as db:
            db.text_factory = lambda raw: raw.decode(errors="replace")
            cursor = db.execute(f"SELECT {picked} FROM {named(self.table)} WHERE {' AND '.join(where)}", values)
            while rows := cursor.fetchmany(ROWS_A_BATCH):
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array([folder] * len(rows) if n == self.tag else columns[i], arrow.field(n).type) for i, (n, _) in enumerate(self.fields)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow) if arrays else pa.RecordBatch.from_pylist([{}] * len(rows))


def sqlite_table(spark: SparkSession, path: str, table: str, columns: str | None = None, tag: str | None = None, rows: int = ROWS_A_PARTITION) -> DataFrame:
    """A table of the SQLite files that path names; columns as DDL picks and prunes them."""
    spark.dataSource.register(SqliteRows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite_rows").option("table", table).option("rows", rows)
    reader = reader.option("tag", tag) if tag else reader
    return (reader.schema(columns) if columns else reader).load(path)
