"""Tables of SQLite files as a Spark data source, read only.

Options: path (one file, or a folder or pattern whose files all hold the table, each a part of it; every executor must see it
under this path), table, rows_per_partition (row ids that one task reads). A file is opened read-only for each task, so a
writer may go on beside it, and each task sees one state of its file.

A task's query names only the columns of the schema that is asked for, the range of its row ids, and the filters that
SQLite can judge as Spark does; Spark judges all filters again, as a column may hold values of other types than declared.
Filters are pushed where spark.sql.python.filterPushdown.enabled is set (see tables).
"""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import PySparkValueError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import BinaryType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Rows of one Arrow batch.
BATCH = 10_000
KINDS = {LongType(): pa.int64(), IntegerType(): pa.int32(), DoubleType(): pa.float64(), StringType(): pa.string(), BinaryType(): pa.binary(), BooleanType(): pa.bool_()}
COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    """Read only; bytes that are no UTF-8 are replaced."""
    connection = sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True, timeout=30)
    connection.text_factory = lambda raw: raw.decode("utf-8", "replace")
    return connection


def files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    found = sorted(glob.glob(f"{path}/*.db") if os.path.isdir(path) else glob.glob(path))
    if not found:
        raise PySparkValueError(f"no SQLite file at {path}")
    return found


def kind(declared: str) -> DataType:
    """By SQLite's rules of affinity; other numbers than whole and floating ones are text."""
    if "INT" in declared:
        return LongType()
    if any(x in declared for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if "BLOB" in declared:
        return BinaryType()
    return DoubleType() if any(x in declared for x in ("REAL", "FLOA", "DOUB")) else StringType()


def declarations(options: dict) -> dict[str, str]:
    connection = opened(files(options["path"])[0])
    try:
        return {name: (declared or "").upper() for _, name, declared, *_ in connection.execute(f"PRAGMA table_info({quoted(options['table'])})")}
    finally:
        connection.close()


def alike(declared: str, own: DataType) -> bool:
    """Whether SQLite compares a column as declared just as Spark compares values of the type."""
    if own == StringType():
        return "INT" not in declared and any(x in declared for x in ("CHAR", "CLOB", "TEXT"))
    return declared != "" and kind(declared) == (LongType() if own == IntegerType() else own)


def condition(pushed: ds.Filter, types: dict[str, DataType]) -> tuple[str, list] | None:
    """SQL of a filter with its values, or nothing where SQLite might leave out what Spark would keep."""
    if isinstance(pushed, ds.Not):
        if isinstance(pushed.child, ds.IsNull):
            return condition(ds.IsNotNull(pushed.child.attribute), types)
        return None  # values of other types would be judged otherwise
    if len(getattr(pushed, "attribute", ())) != 1 or pushed.attribute[0] not in types:
        return None
    name, own = pushed.attribute[0], types[pushed.attribute[0]]
    column = f"{quoted(name)} COLLATE BINARY"
    if isinstance(pushed, ds.IsNull):
        return f"{quoted(name)} IS NULL", []
    if isinstance(pushed, ds.IsNotNull):
        return f"{quoted(name)} IS NOT NULL", []
    fits = lambda v: type(v) is int and own in (LongType(), IntegerType()) or type(v) is str and own == StringType() or type(v) is float and own == DoubleType()
    if type(pushed) in COMPARED and fits(pushed.value):
        return f"{column} {COMPARED[type(pushed)]} ?", [pushed.value]
    if isinstance(pushed, ds.In) and 0 < len(pushed.value) <= 500 and all(map(fits, pushed.value)):
        return f"{column} IN ({', '.join('?' * len(pushed.value))})", list(pushed.value)
    if isinstance(pushed, ds.StringStartsWith) and own == StringType() and pushed.value:
        return f"substr({quoted(name)}, 1, {len(pushed.value)}) = ?", [pushed.value]
    return None


class Rows(ds.InputPartition):
    """Row ids from first to last of a file's table; without them (a view, a table without row ids) the whole of it."""

    def __init__(self, file: str, first: int | None = None, last: int | None = None):
        self.file, self.first, self.last = file, first, last


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema, self.pushed = options, schema, []
        unknown = [f.name for f in schema if f.dataType not in KINDS]
        if unknown:
            raise PySparkValueError(f"types of {unknown} can't be read from SQLite")

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        declared = declarations(self.options)
        types = {f.name: f.dataType for f in self.schema if alike(declared.get(f.name, ""), f.dataType)}
        self.pushed = [c for c in (condition(f, types) for f in filters) if c]
        return filters  # Spark judges all of them again

    def partitions(self) -> list[Rows]:
        step, out = int(self.options.get("rows_per_partition", 1_000_000)), []
        table = quoted(self.options["table"])
        for file in files(self.options["path"]):
            connection = opened(file)
            try:
                first, last = connection.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
            except sqlite3.OperationalError:
                connection.execute(f"SELECT 1 FROM {table} LIMIT 1")  # fails if there is no such table
                out.append(Rows(file))
                continue
            finally:
                connection.close()
            if type(first) is int:  # a view gives nulls
                out += [Rows(file, a, min(a + step - 1, last)) for a in range(first, last + 1, step)]
            elif first is None:
                out.append(Rows(file))
        return out

    def sql(self, part: Rows) -> tuple[str, list]:
        columns = ", ".join(quoted(f.name) for f in self.schema) or "1"
        asked = ([("rowid BETWEEN ? AND ?", [part.first, part.last])] if part.first is not None else []) + self.pushed
        where = " WHERE " + " AND ".join(f"({c})" for c, _ in asked) if asked else ""
        return f"SELECT {columns} FROM {quoted(self.options['table'])}{where}", [v for _, own in asked for v in own]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        connection = opened(partition.file)
        try:
            cursor = connection.execute(*self.sql(partition))
            fields = list(self.schema)
            while rows := cursor.fetchmany(BATCH):
                if not fields:
                    yield pa.RecordBatch.from_struct_array(pa.array([{}] * len(rows), pa.struct([])))
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([_as(v, f) for v in c], KINDS[f.dataType]) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], [f.name for f in fields])
        finally:
            connection.close()


def _as(value: object, field: StructField) -> object:
    """A value of the field's type; one that is none is an error, never another value in silence."""
    own = field.dataType
    if value is None:
        return None
    if own == StringType():
        return value if isinstance(value, str) else str(value) if isinstance(value, int | float) else value.decode("utf-8", "replace")
    if own == BinaryType():
        return value if isinstance(value, bytes) else str(value).encode()
    if own == DoubleType() and type(value) in (int, float):
        return float(value)
    if own == BooleanType() and value in (0, 1):
        return bool(value)
    if own in (LongType(), IntegerType()) and type(value) is int:
        return value
    raise ValueError(f"{field.name} holds {value!r}, which is no {own.simpleString()}")


class SqliteSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        found = declarations(self.options)
        if not found:
            raise PySparkValueError(f"there is no table {self.options['table']}")
        return StructType([StructField(name, kind(declared)) for name, declared in found.items()])

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return Reader(self.options, schema)


def table(spark: SparkSession, path: str, name: str, schema: str | None = None, rows_per_partition: int = 1_000_000) -> DataFrame:
    """A table of the files at path. schema (DDL) says which columns are read, and as what; else all, as they are declared."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite_table").options(path=path, table=name, rows_per_partition=str(rows_per_partition))
    return (reader.schema(schema) if schema else reader).load()


def write(rows: DataFrame, path: str, name: str) -> None:
    """Rows as SQLite files below a folder that all executors share, one for each task, moved into place when it is whole; a
    task that runs again writes its file again. Whole numbers, floating ones, text, bytes and booleans; nulls stay nulls."""
    folder = path.removeprefix("file://")
    words = {LongType(): "INTEGER", IntegerType(): "INTEGER", BooleanType(): "INTEGER", DoubleType(): "REAL", StringType(): "TEXT", BinaryType(): "BLOB"}
    unknown = [f.name for f in rows.schema if f.dataType not in words]
    if unknown:
        raise PySparkValueError(f"types of {unknown} can't be written to SQLite")
    columns = ", ".join(f"{quoted(f.name)} {words[f.dataType]}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        os.makedirs(folder, exist_ok=True)
        whole = f"{folder}/part-{task.partitionId():06d}.db"
        part = f"{whole}.{task.taskAttemptId()}"
        connection = sqlite3.connect(part)
        connection.execute(f"CREATE TABLE {quoted(name)} ({columns})")
        for batch in batches:
            if batch.num_rows:
                connection.executemany(f"INSERT INTO {quoted(name)} VALUES ({', '.join('?' * batch.num_columns)})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
                n += batch.num_rows
        connection.commit()
        connection.close()
        os.replace(part, whole)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.mapInArrow(run, "n long").agg({"n": "sum"}).collect()


def rings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Members (tx_hash, input_index, key_image, amount, idx) and transactions (tx_hash, block_height) of a scanner's store."""
    members = table(spark, path, "ring_members", "tx_hash string, input_index long, key_image string, amount long, global_output_index long")
    return members.withColumnRenamed("global_output_index", "idx"), table(spark, path, "transactions", "tx_hash string, block_height long")
