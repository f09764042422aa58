"""Tables that a run shows all at once, or not at all.

A run writes each of its tables into a folder of its attempt and then, last, one manifest
row that names the attempt. Readers take the newest attempt of each run from the manifest
and read those folders only: a run that was cut off is not seen, and a run that is recorded
again replaces its rows in one step, while readers of the attempt before go on undisturbed.
Attempts that no manifest names, or an older one, can be removed when nobody reads them.
"""

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.sources.readers import read_or_empty

ENTRY = T.StructType([
    T.StructField("number", T.LongType()), T.StructField("run", T.StringType()),
    T.StructField("attempt", T.StringType()),
    T.StructField("tables", T.ArrayType(T.StringType())),
    # Parts that this one was made from, and parts that it stands for from now on.
    T.StructField("covers", T.ArrayType(T.StringType())),
    T.StructField("replaces", T.ArrayType(T.StringType())),
])


def new_attempt() -> str:
    return uuid.uuid4().hex


def part_path(folder: str, table: str, run: str, attempt: str) -> str:
    return f"{folder}/{table}/run={run}/attempt={attempt}"


def part_name(entry: Row) -> str:
    return f"{entry.run}/{entry.attempt}"


def entries(spark: SparkSession, folder: str) -> list[Row]:
    """The newest manifest row of each run, without replaced ones; one row per run."""
    rows = read_or_empty(spark, f"{folder}/manifest", ENTRY,
                         lambda s, p: s.read.schema(ENTRY).json(p)).collect()
    newest: dict[str, Row] = {}
    for row in sorted(rows, key=lambda r: (r.number, r.attempt)):
        newest[row.run] = row
    gone = {name for row in rows for name in row.replaces or ()}
    return [row for row in newest.values() if part_name(row) not in gone]


def publish(spark: SparkSession, folder: str, run: str, attempt: str, tables: Sequence[str],
            covers: Sequence[str] = (), replaces: Sequence[str] = ()) -> None:
    """Show an attempt's tables. The row is one file, which appears in one step."""
    number = max((r.number for r in entries(spark, folder)), default=0) + 1
    row = (number, run, attempt, list(tables), list(covers), list(replaces))
    write_line(spark, dict(zip(ENTRY.names, row, strict=True)), f"{folder}/manifest", "append")


def write_line(spark: SparkSession, values: dict, path: str, mode: str) -> None:
    """Write one JSON line as a file of its own."""
    line = F.lit(json.dumps(values)).alias("value")
    spark.range(0, 1, 1, 1).select(line).write.mode(mode).text(path)


def read_table(spark: SparkSession, folder: str, table: str, schema: T.StructType,
               reader: Callable[..., DataFrame] | None = None, only: Sequence[str] | None = None
               ) -> DataFrame:
    """A published table over all runs, or over the parts named in ``only``."""
    paths = [part_path(folder, table, r.run, r.attempt) for r in entries(spark, folder)
             if table in r.tables and (only is None or part_name(r) in only)]
    if not paths:
        return spark.createDataFrame([], schema)
    load = reader or (lambda source, some: source.parquet(*some))
    rows = load(spark.read.schema(schema).option("basePath", f"{folder}/{table}"), paths)
    return rows.select(*schema.names)
