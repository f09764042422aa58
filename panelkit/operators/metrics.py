"""Counts, shares, latency and rates over the response log.

Everything aggregates before it shuffles. Shares join totals to the counted rows
instead of opening a window, so a group with very many answers never sits in one
task; sums of latency are exact decimals, so a re-run on another partitioning
gives the same digits.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.columns import _col, all_present


def exact_sum(value: Column | str) -> Column:
    """Sum independent of order, of decimals to 18 places and totals below 1e20.

    A double has at most 17 significant digits, so a latency of a millisecond or more
    keeps them all.
    """
    return F.sum(_col(value).cast("decimal(38,18)"))


def exact_mean(value: Column | str) -> Column:
    """Mean over the non-null values, from the exact sum."""
    return exact_sum(value).cast("double") / F.count(_col(value))


def kpi(df: DataFrame, model: str = "model", persona: str = "persona_uuid",
        latency: str = "elapsed_sec") -> DataFrame:
    """Rows, models, mean latency and personas, in one row.

    Two distinct counts in one aggregation would read every row three times over.
    The personas, of which there are many, are counted by themselves; the models are
    so few that the other measures ride along with them.
    """
    personas = df.agg(F.countDistinct(persona)).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(model).alias("n_models"),
        exact_mean(latency).alias("mean_latency"),
    ).withColumn("n_personas", personas)


def group_size(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    """Rows per key; rows with a null key are left out."""
    return df.where(all_present(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def share_of_group(df: DataFrame, group: Sequence[str], answer: str) -> DataFrame:
    """Count of each answer and its percentage of the group."""
    counts = group_size(df, [*group, answer])
    totals = counts.groupBy(*group).agg(F.sum("count").alias("_total"))
    return (
        counts.join(totals, list(group))
        .withColumn("pct", F.col("count") / F.col("_total") * 100)
        .select(*group, answer, "count", "pct")
    )


def cross_count(df: DataFrame, dimension: str, answer: str,
                labels: Sequence[str] | None = None) -> DataFrame:
    """Rows per (dimension, answer).

    ``labels`` lists the values of an ordered dimension: every label is then paired
    with every answer that occurs, with a count of 0 where there are no rows. An answer
    occurs wherever it is given, also on rows outside all labels.
    """
    counts = group_size(df, [dimension, answer])
    if labels is None:
        return counts
    answers = df.where(F.col(answer).isNotNull()).select(answer).distinct()
    cells = answers.select(
        F.explode(F.array(*map(F.lit, labels))).alias(dimension), answer
    )
    return cells.join(counts, [dimension, answer], "left").select(
        dimension, answer, F.coalesce("count", F.lit(0)).alias("count")
    )


def mean_count(df: DataFrame, keys: Sequence[str], value: str = "elapsed_sec") -> DataFrame:
    """Mean and number of the non-null values per key; null keys are left out."""
    return df.where(all_present(*keys)).groupBy(*keys).agg(
        exact_mean(value).alias("mean"), F.count(value).alias("count")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-null values by falling count, equal counts by value."""
    return group_size(df, [column]).orderBy(F.desc("count"), column)


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    """Value counts with their percentage of the total and of the largest count."""
    counts = group_size(df, [column])
    total = counts.agg(F.sum("count")).scalar()
    largest = counts.agg(F.max("count")).scalar()
    return counts.select(
        column, "count",
        (F.col("count") / total * 100).alias("pct"),
        (F.col("count") / largest * 100).alias("bar_pct"),
    )


def non_null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of non-null values of each column."""
    return df.agg(*[F.count(c).alias(c) for c in columns])


def success_rate(good: DataFrame, bad: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Attempts, successes and their ratio over good rows and dead letters."""
    def counted(df: DataFrame, ok: int) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_ok", F.lit(ok))

    both = counted(good, 1).unionByName(counted(bad, 0))
    attempts, done = F.sum("_n"), F.sum(F.col("_n") * F.col("_ok"))
    return both.groupBy(*keys).agg(
        attempts.alias("attempts"), done.alias("successes"), (done / attempts).alias("rate")
    )


def run_summary(parsed: DataFrame, keys: Sequence[str] = (), error: str = "error",
                latency: str | None = "elapsed_sec") -> DataFrame:
    """Attempts, successes, rate and mean latency of the successes, from one pass."""
    ok = F.count_if(F.col(error).isNull())
    measures = [F.count(F.lit(1)).alias("attempts"), ok.alias("successes"),
                (ok / F.count(F.lit(1))).alias("rate")]
    if latency:
        timed = F.when(F.col(error).isNull(), F.col(latency))
        measures.append(exact_mean(timed).alias("mean_latency"))
    return parsed.groupBy(*keys).agg(*measures)
