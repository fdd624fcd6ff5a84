"""Connectors: PostgreSQL, SQL Server, MongoDB, CSV, Excel, JSON and inline rows as DataFrames.

A table is read once as a lazy DataFrame, so there is no paging; a limit is an ordinary limit.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
ROOT_VARIABLE = "CONNECTOR_FILE_ROOT"
MAX_INGEST_VARIABLE = "MAX_INGEST_RECORDS"
MAX_INGEST = 500_000


@dataclass(frozen=True)
class Connection:
    """Where and how to read. An unknown type reads the inline rows."""

    type: str = "MANUAL"
    host: str = ""
    port: int = 0
    database: str = ""
    user: str = ""
    password: str = ""
    schema: str = ""
    table: str = ""
    path: str = ""
    rows: tuple = ()
    options: dict = field(default_factory=dict)


def identifier(name: str) -> str:
    """A plain SQL identifier, or an error."""
    if not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def confined(path: str, root: str | None = None) -> str:
    """The real path of a file below the permitted root; everything is denied without a root."""
    root = root if root is not None else os.environ.get(ROOT_VARIABLE, "")
    if not root:
        raise PermissionError(f"file connectors need {ROOT_VARIABLE}")
    real, base = os.path.realpath(path), os.path.realpath(root)
    if os.path.commonpath((real, base)) != base or real == base:
        raise PermissionError(f"{path} lies outside {root}")
    if os.path.isdir(real):
        raise IsADirectoryError(path)
    return real


def _jdbc(spark: SparkSession, c: Connection, url: str, quoted: str) -> DataFrame:
    reader = spark.read.format("jdbc").options(url=url, user=c.user, password=c.password, dbtable=quoted)
    split = {k: c.options[k] for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions", "fetchsize") if k in c.options}
    if "partitionColumn" in split:
        identifier(split["partitionColumn"])
    return reader.options(**split).load()


def postgres_query(spark: SparkSession, c: Connection, table: str) -> DataFrame:
    return _jdbc(spark, c, f"jdbc:postgresql://{c.host}:{c.port or 5432}/{identifier(c.database)}", table)


def postgres(spark: SparkSession, c: Connection) -> DataFrame:
    return postgres_query(spark, c, f'"{identifier(c.schema or "public")}"."{identifier(c.table)}"')


def sqlserver_query(spark: SparkSession, c: Connection, table: str) -> DataFrame:
    return _jdbc(spark, c, f"jdbc:sqlserver://{c.host}:{c.port or 1433};databaseName={identifier(c.database)};encrypt=true", table)


def sqlserver(spark: SparkSession, c: Connection) -> DataFrame:
    return sqlserver_query(spark, c, f"[{identifier(c.schema or 'dbo')}].[{identifier(c.table)}]")


def mongodb(spark: SparkSession, c: Connection) -> DataFrame:
    """Through the public MongoDB connector, which must be on the class path. Documents that can't be decoded are left out."""
    login = f"{c.user}:{c.password}@" if c.user else ""
    uri = f"mongodb://{login}{c.host}:{c.port or 27017}"
    found = spark.read.format("mongodb").options(**{"connection.uri": uri, "database": c.database, "collection": c.table, "mode": "DROPMALFORMED"})
    return plain_ids(found.load())


def csv(spark: SparkSession, c: Connection) -> DataFrame:
    """A header line, all columns text, header names trimmed; a row of another length is an error."""
    path = confined(c.path, c.options.get("root"))
    with open(path, encoding="utf-8-sig", newline="") as f:
        import csv as plain

        header = [h.strip() for h in next(plain.reader(f), [])]
    schema = ", ".join(f"`{h}` string" for h in header)
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", multiLine=True, escape='"', enforceSchema=True).csv(f"file://{path}")


def excel(spark: SparkSession, c: Connection) -> DataFrame:
    """The named sheet or the first, all columns text. The sheet is read on the driver, as a workbook is one file."""
    import pandas as pd

    path = confined(c.path, c.options.get("root"))
    sheet = pd.read_excel(path, sheet_name=c.options.get("sheet", 0), dtype=str)
    sheet.columns = [str(h).strip() for h in sheet.columns]
    return spark.createDataFrame(sheet.astype(object).where(sheet.notna(), None), schema=", ".join(f"`{h}` string" for h in sheet.columns))


def json_rows(spark: SparkSession, c: Connection) -> DataFrame:
    """An array of objects, or one object a line."""
    return spark.read.option("multiLine", c.options.get("multi_line", True)).json(f"file://{confined(c.path, c.options.get('root'))}")


def manual(spark: SparkSession, c: Connection) -> DataFrame:
    """Inline rows; a column that a row lacks is null there."""
    if not c.rows:
        return spark.createDataFrame([], "customer_name string")
    names = list(dict.fromkeys(k for r in c.rows for k in r))
    text = [tuple(None if r.get(k) is None else str(r[k]) for k in names) for r in c.rows]
    return spark.createDataFrame(text, ", ".join(f"`{k}` string" for k in names))


KINDS = {"POSTGRES": postgres, "SQLSERVER": sqlserver, "MONGODB": mongodb, "CSV": csv, "EXCEL": excel, "JSON": json_rows, "MANUAL": manual}


def read(spark: SparkSession, c: Connection) -> DataFrame:
    return KINDS.get(c.type.upper(), manual)(spark, c)


def introspect(spark: SparkSession, c: Connection) -> list[tuple[str, str]]:
    """Names and types of the columns."""
    return read(spark, c).dtypes


def test(spark: SparkSession, c: Connection) -> bool:
    """Whether a first row can be asked for."""
    read(spark, c).limit(1).count()
    return True


def max_ingest() -> int:
    """The most rows that one side of an ingest reads; a variable that is no positive number is ignored."""
    raw = os.environ.get(MAX_INGEST_VARIABLE, "").strip()
    return int(raw) if raw.isdecimal() and int(raw) > 0 else MAX_INGEST


#: The primary key's columns in order, as both databases describe it.
_KEY = """(SELECT k.column_name AS name, k.ordinal_position AS place FROM information_schema.table_constraints t
    JOIN information_schema.key_column_usage k ON k.constraint_name = t.constraint_name AND k.table_schema = t.table_schema AND k.table_name = t.table_name
    WHERE t.constraint_type = 'PRIMARY KEY' AND t.table_schema = '{0}' AND t.table_name = '{1}') keys"""


def primary_key(spark: SparkSession, c: Connection) -> tuple[str, ...]:
    """The columns of the table's primary key; none for what is no database."""
    kind = c.type.upper()
    if kind == "MONGODB":
        return ("_id",)
    if kind == "POSTGRES":
        rows = postgres_query(spark, c, _KEY.format(identifier(c.schema or "public"), identifier(c.table)))
    elif kind == "SQLSERVER":
        rows = sqlserver_query(spark, c, _KEY.format(identifier(c.schema or "dbo"), identifier(c.table)))
    else:
        return ()
    return tuple(r["name"] for r in rows.orderBy("place").collect())


def total_order(df: DataFrame, explicit: str = "", key: tuple[str, ...] = ()) -> list[str]:
    """The columns that order rows totally: those asked for (names with commas), else the primary key, else all that can be ordered.

    An order that is asked for must consist of plain identifiers. Rows that agree in all columns are equal,
    so their order does not matter. A table without a column that can be ordered raises an error.
    """
    if explicit.strip():
        return [identifier(c.strip()) for c in explicit.split(",")]
    found = list(key) or [f.name for f in df.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    if not found:
        raise ValueError("rows can't be ordered: there is no primary key and no column that can be ordered; set order_by")
    return found


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows of a page in a total order."""
    return df.orderBy(*(f"`{c}`" for c in order)).offset(max(offset, 0)).limit(max(limit, 0))


def capped(df: DataFrame, cap: int | None = None, order: list[str] | None = None) -> tuple[DataFrame, bool]:
    """The first ``cap`` rows in a total order and whether there were more, by asking for one more row.

    A table with no more rows than that is not sorted.
    """
    cap = max_ingest() if cap is None else cap
    if df.limit(cap + 1).count() <= cap:
        return df, False
    return page(df, order or total_order(df), cap), True


def plain_ids(df: DataFrame) -> DataFrame:
    """Documents with object identifiers as hexadecimal text, in arrays and nested documents too.

    An identifier is a struct with the one field oid or $oid, or twelve bytes in a column _id.
    """

    def plain(c: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StructType):
            if [f.name for f in kind] in (["oid"], ["$oid"]):
                return plain(c.getField(kind[0].name), kind[0].dataType, "_id")
            return F.when(c.isNotNull(), F.struct(*(plain(c.getField(f.name), f.dataType, f.name).alias(f.name) for f in kind)))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: plain(x, kind.elementType, name))
        return F.lower(F.hex(c)) if isinstance(kind, T.BinaryType) and name == "_id" else c

    return df.select(*(plain(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema))
