"""Tables laid out by the persona's key, so that joins on it move nothing.

A table of the catalog is written in a fixed number of buckets by a hash of its key, sorted
within each. Two tables with one number of buckets meet bucket by bucket: anti, semi and
outer joins on the key, and aggregations by it, need no shuffle on either side. A log grows
by appended runs; each adds a file per bucket, and ``compact`` writes them anew.

A persona with a third of the rows stays in one bucket. Joins that only ask whether a key is
there reduce each side to its keys first, within the bucket.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BUCKETS = 200


def write_laid_out(df: DataFrame, table: str, key: str = "persona_uuid", buckets: int = BUCKETS,
                   path: str | None = None, mode: str = "append") -> None:
    """Add rows to a table of the catalog, made at the first write; ``path`` puts it elsewhere.

    Rows are dealt to as many tasks as buckets first, by the hash that buckets go by, so each
    task writes one file.
    """
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    dealt = df.repartitionById(buckets, bucket).sortWithinPartitions(key)
    writer = dealt.write.mode(mode).bucketBy(buckets, key).sortBy(key)
    if path and not df.sparkSession.catalog.tableExists(table):
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def read_laid_out(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def layout(spark: SparkSession, table: str) -> tuple[str, int] | None:
    """The key and number of buckets of a table; None if it is not laid out."""
    try:
        rows = spark.sql(f"DESCRIBE EXTENDED {table}").collect()
    except AnalysisException as problem:
        if problem.getCondition() != "TABLE_OR_VIEW_NOT_FOUND":
            raise
        return None
    about = {r.col_name: r.data_type for r in rows}
    count, keys = about.get("Num Buckets"), about.get("Bucket Columns", "[]").strip("[]` ")
    return (keys, int(count)) if count and int(count) > 0 else None


def compact(spark: SparkSession, table: str, target: str, path: str | None = None) -> None:
    """Write a table's rows as another of the same layout, with one file per bucket."""
    found = layout(spark, table)
    if found is None:
        raise ValueError(f"{table} is not laid out")
    write_laid_out(spark.table(table), target, found[0], found[1], path, mode="errorifexists")


def unanswered(panel: DataFrame, log: DataFrame, model: str, version: str,
               key: str = "persona_uuid") -> DataFrame:
    """Rows of a laid-out panel without an answer in a laid-out log under a model and version."""
    done = log.where((F.col("model") == model) & (F.col("voter_context_version") == version))
    return panel.join(done.select(key).distinct(), key, "left_anti")


def answered(panel: DataFrame, log: DataFrame, model: str, version: str,
             key: str = "persona_uuid", columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of a laid-out panel with such an answer; ``columns`` narrows them first."""
    done = log.where((F.col("model") == model) & (F.col("voter_context_version") == version))
    rows = panel.select(key, *columns) if columns is not None else panel
    return rows.join(done.select(key).distinct(), key, "left_semi")
