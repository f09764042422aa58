"""Feeds, previews and seeded samples.

A sample is the first n keys in the order of ``md5(seed|key)``: the same on every run
and every partitioning. Up to ``FEW`` rows (``FEW_PER_GROUP`` per group) are found in one
pass: each task keeps its n lowest hashes, and these few are merged. For larger samples
operators first find where the n-th row lies, on keys alone, and take the whole rows last.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkit.operators.numbering import number_rows

# Hash digits a level of the search looks at, and levels. Rows that agree with the n-th in
# all of them, about one in 16^12, are ranked in one window.
HASH_DIGITS = 4
LEVELS = 3
# Largest samples that every task may hold; per group Spark's own limit for it is 1,000.
FEW, FEW_PER_GROUP = 10_000, 1_000


def _edge_of_first(df: DataFrame, column: Column, n: int, ascending: bool) -> Column:
    """The n-th non-null value of a column, as a scalar subquery; null if there are fewer."""
    order, last = (F.asc, F.max) if ascending else (F.desc, F.min)
    first = df.select(column.alias("_o")).where(F.col("_o").isNotNull()).orderBy(
        order("_o")).limit(n)
    return first.agg(F.when(F.count("_o") == n, last("_o"))).scalar()


def recent(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The last n rows by the columns of ``order``, newest first, nulls last.

    The test on the first column is an ordinary predicate, so on a log that grows in
    time order the scan skips all but the newest files.
    """
    first = F.col(order[0])
    edge = _edge_of_first(df, first, n, ascending=False)
    newest = df.where((first >= edge) | edge.isNull())
    return newest.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(n)


def head(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """The first n rows by the columns of ``order``, nulls last."""
    first = F.col(order[0])
    edge = _edge_of_first(df, first, n, ascending=True)
    oldest = df.where((first <= edge) | edge.isNull())
    return oldest.orderBy(*[F.asc_nulls_last(c) for c in order]).limit(n)


def seeded_hash(seed: int | str, *keys: Column | str) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0, few: int = FEW) -> DataFrame:
    """n rows of a table with one row per key, without repeats; rows without key are left out."""
    rows = df.withColumns({"_hash": seeded_hash(seed, key), "_n": F.lit(n)})
    if n <= few:
        first = rows.where(F.col(key).isNotNull()).orderBy("_hash", key).limit(n)
        return first.select(*df.columns)
    return _first_keys(rows, [], key).select(*df.columns)


def sample_per_stratum(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0,
                       digits: int = HASH_DIGITS, few: int = FEW_PER_GROUP) -> DataFrame:
    """n rows of each stratum, or all where it has fewer; a null stratum is one too."""
    keys = df.select(stratum, key).withColumns(
        {"_hash": seeded_hash(seed, key), "_n": F.lit(n)})
    drawn = (_lowest_keys(keys, [stratum], key, n) if n <= few
             else _first_keys(keys, [stratum], key, digits))
    return df.join(drawn.select(key), key).select(*df.columns)


def _lowest_keys(keys: DataFrame, group: Sequence[str], key: str, most: int) -> DataFrame:
    """The ``_n`` keys of each group with the lowest ``_hash``, for ``_n`` up to ``most``.

    The test against a literal lets every task keep ``most`` keys of a group before the
    shuffle, so the window over a group has no more than that from each task.
    """
    place = F.row_number().over(W.partitionBy(*group).orderBy("_hash", key))
    return keys.where(F.col(key).isNotNull()).withColumn("_place", place).where(
        F.col("_place") <= F.lit(most)).where(F.col("_place") <= F.col("_n")).drop("_place")


def _first_keys(keys: DataFrame, group: Sequence[str], key: str, digits: int = HASH_DIGITS,
                levels: int = LEVELS) -> DataFrame:
    """The ``_n`` keys of each group with the lowest ``_hash``.

    Each level counts the keys per hash prefix, combined before the shuffle, and goes on
    in the prefix where the n-th key lies: at most 16^digits counts per group. Keys
    before that prefix are taken as they stream by. Only keys that share the whole prefix
    with the n-th are ranked, so a group with a third of the table stays spread.
    """
    keys = keys.where(F.col(key).isNotNull())
    ends = None
    for level in range(1, levels + 1):
        at = F.substring("_hash", 1, digits * level)
        inside = keys if ends is None else _with_ends(keys, ends, group).where(
            F.substring("_hash", 1, digits * (level - 1)) == F.col("_last"))
        start = F.lit(0) if ends is None else F.col("_before")
        counts = inside.groupBy(*group, at.alias("_at")).agg(
            F.count(F.lit(1)).alias("_rows"), F.max("_n").alias("_n"),
            F.max(start).alias("_start"))
        earlier = F.sum("_rows").over(
            W.partitionBy(*group).orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
        # The last prefix that begins before the n-th key: it holds it, or is the last of all.
        ends = (
            counts.withColumn("_first", F.col("_start") + F.coalesce(earlier, F.lit(0)))
            .where(F.col("_first") < F.col("_n"))
            .groupBy(*[F.col(c).alias(f"_end{c}") for c in group])
            .agg(F.max(F.struct("_at", "_first")).alias("_end"))
            .select(*[f"_end{c}" for c in group], F.col("_end._at").alias("_last"),
                    F.col("_end._first").alias("_before"))
        )
    prefix = F.substring("_hash", 1, digits * levels)
    found = _with_ends(keys, ends, group)
    place = F.row_number().over(W.partitionBy(*group).orderBy("_hash", key))
    sure = found.where(prefix < F.col("_last"))
    edge = (
        found.where(prefix == F.col("_last")).withColumn("_place", place)
        .where(F.col("_place") <= F.col("_n") - F.col("_before"))
    )
    return sure.select(*keys.columns).unionByName(edge.select(*keys.columns))


def _with_ends(keys: DataFrame, ends: DataFrame, group: Sequence[str]) -> DataFrame:
    """Keys with their group's end; one group's end is a scalar and joins nothing."""
    if group:
        return keys.join(ends, [keys[c].eqNullSafe(ends[f"_end{c}"]) for c in group])
    end = ends.select(F.struct("_last", "_before")).scalar()
    return keys.withColumns(
        {"_last": end.getField("_last"), "_before": end.getField("_before")})


def draw_with_repeats(df: DataFrame, shard: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n independent draws: a shard at random, then a row of it; repeats can occur.

    The keys are numbered by (shard, key), so a draw is a row number and joins its key
    by it; whole rows are read only for the keys drawn. A draw's two random numbers come
    from its own hash. Keys are unique and shards are not null.
    """
    spark = df.sparkSession
    numbered = number_rows(df.select(shard, key), [shard, key], "_row")
    shards = number_rows(
        numbered.groupBy(shard).agg(
            F.min("_row").alias("_start"), F.count(F.lit(1)).alias("_size")),
        [shard], "_shard",
    ).select("_shard", "_start", "_size")
    n_shards = shards.agg(F.count(F.lit(1))).scalar()

    def uniform(name: str) -> Column:
        text = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), F.col("draw").cast("string")))
        return F.conv(F.substring(text, 1, 12), 16, 10).cast("bigint")

    draws = spark.range(n).select(
        F.col("id").alias("draw"), uniform("shard").alias("_a"), uniform("row").alias("_b"))
    picked = draws.withColumn("_shard", F.pmod("_a", n_shards)).join(shards, "_shard")
    drawn = (
        picked.select("draw", (F.col("_start") + F.pmod("_b", "_size")).alias("_row"))
        .join(numbered, "_row").drop("_row")
    )
    return drawn.join(df, [shard, key]).select("draw", *df.columns)


def run_grid(df: DataFrame, key: str, cells: Sequence[tuple[str, str, int]], seed: int = 0,
             model: str = "model", version: str = "version", few: int = FEW_PER_GROUP
             ) -> DataFrame:
    """Personas to ask in each (model, version, count) cell of a hand-written grid.

    Each cell takes its own sample of the panel. Only keys are repeated per cell, by one
    literal; whole rows join the keys drawn.
    """
    grid = F.array(*[
        F.struct(F.lit(m).alias(model), F.lit(v).alias(version), F.lit(n).alias("_n"))
        for m, v, n in cells
    ])
    keys = df.select(key, F.inline(grid)).withColumn(
        "_hash", seeded_hash(seed, model, version, key))
    most = max((n for *_, n in cells), default=0)
    first = (_lowest_keys(keys, [model, version], key, most) if most <= few
             else _first_keys(keys, [model, version], key))
    drawn = first.select(key, model, version)
    return df.join(drawn, key).select(*df.columns, model, version)
