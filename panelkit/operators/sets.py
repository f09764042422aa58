"""Options of filters, versions with both assets, appended tables, differences."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.columns import version_number


def filter_options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct non-null values of several columns as (column, value), in one pass."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in columns
    ])
    return (
        df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
        .orderBy("column", "value")
    )


def paired_versions(assets: DataFrame, kinds: tuple[str, str] = ("voter_context", "system_prompt"),
                    kind: str = "kind", version: str = "version") -> DataFrame:
    """Versions that have an asset of both kinds, in numeric order."""
    def of(name: str) -> DataFrame:
        return assets.where(F.col(kind) == name).select(version)

    return (
        of(kinds[0]).intersect(of(kinds[1]))
        .withColumn("version_number", version_number(version)).orderBy("version_number")
    )


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both tables, columns matched by name, absent ones null."""
    return log.unionByName(new, allowMissingColumns=True)


def difference(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the first table that the second does not have."""
    return targets.select(key).subtract(done.select(key))
