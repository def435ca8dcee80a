"""SQLite tables as a data source: a table is read by ranges of its rowid, each range by a task of its own.

``spark.read.format("sqlite_rows").schema(...).option("path", file).option("table", name).option("partitions", n).load()``:
the schema names the columns that are read, so a scan of two columns reads two. The file lies where all executors can open
it; it is opened read-only. Tables without a rowid, and views, are one range.
"""

from __future__ import annotations

import ast
import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ROWS = 10_000


def _open(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Range(InputPartition):
    def __init__(self, first: int | None, last: int | None):
        self.first, self.last = first, last


class Rows(DataSourceReader):
    def __init__(self, schema: StructType, path: str, table: str, ranges: int):
        self.columns, self.path, self.table, self.ranges = schema.fieldNames(), path, table, ranges

    def partitions(self) -> list[InputPartition]:
        """Ranges of equal width between the smallest and the largest rowid; both are found by the table's own tree."""
        with closing(_open(self.path)) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError as e:
                if "rowid" not in str(e):
                    raise
                return [Range(None, None)]
        if low is None:
            return [Range(0, -1)]
        width = -(-(high - low + 1) // max(self.ranges, 1))
        return [Range(a, min(a + width - 1, high)) for a in range(low, high + 1, width)]

    def read(self, partition: Range) -> Iterator[tuple]:
        where, values = ("", ()) if partition.first is None else (" WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last))
        with closing(_open(self.path)) as con:
            cursor = con.execute(f"SELECT {', '.join(map(_quoted, self.columns)) or '1'} FROM {_quoted(self.table)}{where}", values)
            while rows := cursor.fetchmany(ROWS):
                yield from rows


class SQLiteRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> str:
        """All columns of the table as they are declared, where no schema is asked for."""
        with closing(_open(self.options["path"])) as con:
            declared = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        kind = lambda t: "long" if "INT" in t.upper() else "double" if any(x in t.upper() for x in ("REAL", "FLOA", "DOUB")) else "string"
        return ", ".join(f"`{name}` {kind(of)}" for _, name, of, *_ in declared)

    def reader(self, schema: StructType) -> Rows:
        return Rows(schema, self.options["path"], self.options["table"], int(self.options.get("partitions", 8)))


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 8) -> DataFrame:
    """The columns of schema (names and types) of a table."""
    spark.dataSource.register(SQLiteRows)
    return spark.read.format("sqlite_rows").schema(schema).option("path", path).option("table", table).option("partitions", partitions).load()


def lines_of(diff: str | None) -> list[int] | None:
    """Numbers of the deleted lines of a recorded diff, a literal {"added": [(number, text), ...], "deleted": [...]}; None where it can't be read."""
    try:
        return [int(number) for number, _ in ast.literal_eval(diff)["deleted"]] if diff else None
    except (ValueError, SyntaxError, TypeError, KeyError, RecursionError, MemoryError):
        return None


def deleted_lines(column: str) -> Column:
    @F.pandas_udf("array<long>")
    def read(diffs: pd.Series) -> pd.Series:
        return pd.Series([lines_of(d) for d in diffs], dtype=object)

    return read(F.col(column))


def fix_commits(spark: SparkSession, path: str, partitions: int = 8) -> dict[str, DataFrame]:
    """The tables of a database of fix commits, by name: changes, commits, fixes, classification; deleted lines come from the recorded diff."""
    change = sqlite_table(spark, path, "file_change", "hash string, filename string, old_path string, change_type string, diff_parsed string, code_before string, programming_language string", partitions)
    changes = change.select("hash", "filename", "old_path", "code_before", deleted_lines("diff_parsed").alias("deleted"), F.lower("programming_language").alias("language"), F.upper(F.regexp_extract("change_type", r"([A-Za-z]+)$", 1)).alias("change_type"))
    return {
        "changes": changes, "commits": sqlite_table(spark, path, "commits", "hash string, repo_url string", partitions).select("hash", F.col("repo_url").alias("repo")), "fixes": sqlite_table(spark, path, "fixes", "hash string, cve_id string", partitions),
        "classification": sqlite_table(spark, path, "cwe_classification", "cve_id string, cwe_id string", partitions),
    }
