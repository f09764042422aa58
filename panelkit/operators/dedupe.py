"""One row per key, by an explicit order.

``dropDuplicates`` keeps an arbitrary row, so it is not used. The aggregate below
reduces each key inside every map task before the shuffle: a key that holds a
third of the log sends one row per task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keep(df: DataFrame, keys: Sequence[str], order: Column, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*rest) if rest else F.lit(True), order).alias("_row")
    kept = df.groupBy(*keys).agg(row)
    return kept.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`") for c in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    return _keep(df, keys, order, F.max_by)
