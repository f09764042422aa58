"""Equi-joins on the persona key.

Notes, cohorts and finished keys grow with the panel, so no hint broadcasts them:
the planner's size check and adaptive skew splitting choose the way. Null keys
match nothing.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# A table marked for broadcast has at most so many rows and bytes of text.
MAX_BROADCAST_ROWS = 1_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def broadcast_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                    max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The table marked for broadcast if its rows and their text are few, else as it is."""
    text = F.octet_length(F.to_json(F.struct("*")))
    size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0)))
    rows, size_bytes = size.first()
    return F.broadcast(df) if rows <= max_rows and size_bytes <= max_bytes else df


def enrich(df: DataFrame, notes: DataFrame, key: str = "persona_uuid") -> DataFrame:
    """Every row with its notes; several notes of one key repeat the row."""
    return df.join(notes, key, "left")


def coverage(df: DataFrame, notes: DataFrame, key: str = "persona_uuid",
             note: str = "political_interest") -> DataFrame:
    """Rows after ``enrich`` and how many of them have no note.

    Both sides are counted per key first. Only keys and counts are shuffled, and a
    key that repeats on both sides is multiplied, not joined row by row.
    """
    left = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    right = notes.groupBy(key).agg(
        F.count(F.lit(1)).alias("_notes"), F.count(note).alias("_filled"))
    per_row = F.coalesce("_notes", F.lit(1))
    missing = per_row - F.coalesce("_filled", F.lit(0))
    return left.join(right, key, "left").agg(
        F.coalesce(F.sum(F.col("_rows") * per_row), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_rows") * missing), F.lit(0)).alias("n_missing"),
    )


def not_done(targets: DataFrame, done: DataFrame, keys: Sequence[str] = ("persona_uuid",)
             ) -> DataFrame:
    """Targets whose key is not among the finished ones.

    The finished keys are made distinct before the shuffle, so a log with many
    rows per key sends each key once per task.
    """
    return targets.join(done.select(*keys).distinct(), list(keys), "left_anti")


def cohort(df: DataFrame, members: DataFrame, keys: Sequence[str] = ("persona_uuid",)
           ) -> DataFrame:
    """Rows of exactly the personas in another table."""
    return df.join(members.select(*keys).distinct(), list(keys), "left_semi")


def attach_by_version(df: DataFrame, assets: DataFrame, version: str = "version") -> DataFrame:
    """The prompt texts of each row's version; rows of an unknown version get nulls.

    There are few versions with very many rows each. Few texts are broadcast. More are kept
    in every salt, so a version's rows still spread over the tasks.
    """
    small = broadcast_small(assets)
    if small is not assets:
        return df.join(small, version, "left")
    salted = assets.select("*", F.explode(
        F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [version, "_salt"], "left").drop("_salt")


def attach_notes(chunked: DataFrame, notes: DataFrame,
                 keys: Sequence[str] = ("chunk_id", "idx")) -> DataFrame:
    """The note written for each (chunk, position), on its persona."""
    return chunked.join(notes, list(keys))


def lookup_join(df: DataFrame, values: DataFrame, key: str, value: str, default: str
                ) -> DataFrame:
    """A looked-up value per row, or the default; for lists too long for a literal."""
    return df.join(values.select(key, value), key, "left").withColumn(
        value, F.coalesce(value, F.lit(default)))
