"""Row numbers and chunks over a whole table without gathering it in one task."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkit import fixed_values as fv
from panelkit.runtime import new_folder


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Add the 0-based place of each row in the given order, which must be unique.

    The rows are range-partitioned, sorted and written once, one ordered run of
    files per task: range bounds come from a sample, so the layout has to be fixed
    before file sizes can serve as offsets. A row's place is the rows of the files
    before its own plus its position in the file, which the reader knows.
    """
    path = new_folder(df.sparkSession, "ordered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    placed = df.sparkSession.read.schema(df.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_position"))
    # part-00012-...-c000: task and, where a task wrote several, file within the task.
    task = F.regexp_extract("_file", r"^part-(\d+)-", 1).cast("int")
    piece = F.regexp_extract("_file", r"-c(\d+)\.", 1).cast("int")
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        W.orderBy(task, piece).rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_offset"))
    # One row per written file: bounded by the number of tasks, whatever the table holds.
    return (
        placed.join(F.broadcast(offsets), "_file")
        .withColumn(name, F.col("_offset") + F.col("_position"))
        .drop("_file", "_position", "_offset")
    )


def chunk_rows(df: DataFrame, order: Sequence[str], size: int = fv.CHUNK_SIZE) -> DataFrame:
    """Add ``chunk_id`` from 1 and the place ``idx`` from 0 in it; only the last may be short.

    The columns of ``order`` alone are sorted, written and numbered; each row then finds its
    number by them, so whole rows move once at most and are never written.
    """
    numbers = number_rows(df.select(*order), order, "_row").withColumnsRenamed(
        {c: f"_key_{c}" for c in order})
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return (
        df.join(numbers, same).select(*df.columns, "_row")
        .withColumn("chunk_id", (F.floor(F.col("_row") / size) + 1).cast("int"))
        .withColumn("idx", F.pmod("_row", F.lit(size)).cast("int"))
        .drop("_row")
    )
