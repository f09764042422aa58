"""A table that grows by batches and is merged in levels, so that readers open few parts.

Each batch adds one part to level 0. When a level has ``WIDTH`` parts they are merged into
one part of the next level: a row is written again once per level, and after n batches a
reader opens at most ``WIDTH`` parts in each of log(n) levels. A batch then writes its
manifest, the whole list of live parts under the batch's number; readers list the manifests
and open the newest. A batch that runs again after a failure writes parts of new names and
its manifest anew, starting from the one before, so it is never counted twice. Parts and
manifests that no reader uses any more can be removed.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.sources.published import write_line
from panelkit.sources.readers import read_or_empty

WIDTH = 8
MANIFEST = T.StructType([
    T.StructField("parts", T.ArrayType(T.StructType([
        T.StructField("level", T.IntegerType()), T.StructField("path", T.StringType())]))),
    T.StructField("number", T.LongType())])

Part = tuple[int, str]


def live_parts(spark: SparkSession, path: str, before: int | None = None) -> list[Part]:
    """The (level, path) of each part of the newest batch, or of the newest before one."""
    listed = read_or_empty(spark, f"{path}/manifest", MANIFEST,
                           lambda s, p: s.read.schema(MANIFEST).json(p))
    if before is not None:
        listed = listed.where(F.col("number") < before)
    # The number is a folder name, so the newest is found without opening the others.
    newest = listed.where(F.col("number") == listed.agg(F.max("number")).scalar()).collect()
    return [(p.level, p.path) for row in newest for p in row.parts]


def read_parts(spark: SparkSession, parts: list[Part], schema: T.StructType) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[p for _, p in parts])


def read_levels(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of the live parts, not merged across parts."""
    return read_parts(spark, live_parts(spark, path), schema)


def add_batch(rows: DataFrame, path: str, batch: int,
              merge: Callable[[DataFrame], DataFrame] | None = None, width: int = WIDTH) -> None:
    """Add a batch's rows, merging full levels; ``merge`` reduces the rows of merged parts."""
    spark, schema = rows.sparkSession, rows.schema

    def write(part: DataFrame, level: int) -> Part:
        target = f"{path}/parts/{level}-{batch}-{uuid.uuid4().hex}"
        part.write.parquet(target)
        return level, target

    parts = [*live_parts(spark, path, before=batch), write(rows, 0)]
    level = 0
    while len(full := [p for p in parts if p[0] == level]) >= width:
        together = read_parts(spark, full, schema)
        together = (merge(together) if merge else together).hint("rebalance")
        parts = [p for p in parts if p[0] != level] + [write(together, level + 1)]
        level += 1
    entry = {"parts": [{"level": at, "path": target} for at, target in parts]}
    write_line(spark, entry, f"{path}/manifest/number={batch}", "overwrite")
