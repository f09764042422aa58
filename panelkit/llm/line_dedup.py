"""Line dedup: explode lines, hash, count documents per hash, drop, reassemble by position.

Defined results: a null text is one empty line; a repeated row counts once (equal doc_id)
and both rows get the same result; all rows without doc_id are one document that no line
stays in if another holds it; an empty table gives an empty table; other columns pass
through unless they start with an underscore or bear the name of a result column.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import cut, line_key, lines_of, two_hashes

MIN_POINTS = 20
MIN_DOCUMENTS = 3


def keyed_lines(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """One row per line that is long enough to count: document, position and key hash."""
    return (
        docs.select("doc_id", F.xxhash64("text").alias("_text"),
                    F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "_text", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_points)
        .select("doc_id", "_text", "pos", *two_hashes(F.col("key")))
    )


def shared_keys(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Keys found in at least so many documents, and the largest doc_id of each.

    Spark counts distinct documents in two steps, so a key of a third of all lines is
    spread over tasks by document first and arrives as one row per task.
    """
    without = F.max(F.col("doc_id").isNull().cast("int"))
    return (
        lines.groupBy("h1", "h2")
        .agg((F.count_distinct("doc_id") + without).alias("_n"), F.max("doc_id").alias("keeper"))
        .where(F.col("_n") >= min_documents)
        .drop("_n")
    )


def same_row(left: str, right: str) -> Column:
    return (
        F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))
        & (F.col(f"{left}._text") == F.col(f"{right}._text"))
    )


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS,
                min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with ``text`` without repeated lines, ``n_lines`` and ``n_dropped``.

    A key's lines stay in the largest doc_id that holds it. Texts move once, in the join
    that brings each document the positions it loses; lines move as hashes.
    """
    lines = cut(keyed_lines(docs, min_points), "lines")
    shared = cut(shared_keys(lines, min_documents), "shared-lines")
    lost = (
        lines.join(shared, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "_text")
        .agg(F.collect_set("pos").alias("_lost"))
    )
    rest = [c for c in docs.columns
            if c not in ("text", "n_lines", "n_dropped") and not c.startswith("_")]
    split = docs.select(
        *rest, F.xxhash64("text").alias("_text"), lines_of(F.col("text")).alias("_lines"))
    whole = F.size("_lines")
    # The lines come through the join as a column, so the lambda picks from it.
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), whole - 1), F.col("_lost")),
        lambda i: F.get("_lines", i))
    return (
        split.alias("d").join(lost.alias("l"), same_row("d", "l"), "left")
        .select(
            *[F.col(f"d.{c}") for c in rest],
            F.array_join(F.when(F.col("_lost").isNull(), F.col("_lines")).otherwise(kept), "\n")
            .alias("text"),
            whole.cast("long").alias("n_lines"),
            F.greatest(F.coalesce(F.size("_lost"), F.lit(0)), F.lit(0)).cast("long")
            .alias("n_dropped"),
        )
    )
