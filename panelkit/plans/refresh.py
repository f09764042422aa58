"""Panels that are brought up to date from the new runs alone.

For each recorded run a few mergeable tables are kept beside the log: counts and exact sums
per cell, counts per dimension, the values that occur, the personas, and each persona's
first and last answer per cell as the state of ``min_by`` and ``max_by``. Merging parts is
adding counts and taking the least or greatest state, so the panels from merged parts equal
those from the whole log. ``refresh`` reads only parts of the log that no kept part covers;
``fold`` merges many parts into one. A run that was recorded again is read again, with the
others whose counts were folded together with it.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit import fixed_values as fv
from panelkit.functions.columns import all_present, log_order
from panelkit.operators import compare, metrics
from panelkit.operators.filters import complete, where_selected
from panelkit.plans.panels import log_view
from panelkit.plans.runs import logged
from panelkit.runtime import at_once
from panelkit.sources import published

# Parts that a reader merges before ``refresh`` folds them into one.
FOLD_AT = 16
CELL = ("model", "voter_context_version", "system_prompt_version")
DIMENSIONS = ("age_bucket", "province", "sex")
LISTED = (*fv.FACETS, *CELL)


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _state(name: str) -> T.StructField:
    return T.StructField(name, T.StructType(_strings("order", "vote")))


COUNT = T.StructField("count", T.LongType())
SCHEMAS = {
    "cells": T.StructType([
        *_strings(*CELL, "version", "vote"), COUNT, T.StructField("timed", T.LongType()),
        T.StructField("time", T.DecimalType(38, 18))]),
    "dimensions": T.StructType([*_strings(*CELL, "dimension", "value", "vote"), COUNT]),
    "values": T.StructType(_strings("column", "value")),
    "personas": T.StructType(_strings("persona_uuid")),
    "answers": T.StructType([
        *_strings("persona_uuid", "model", "voter_context_version"),
        _state("first"), _state("last")]),
}


def partials(log: DataFrame) -> dict[str, DataFrame]:
    """The mergeable tables of a log, each combined before its shuffle."""
    view = log_view(log)
    named = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS]
    listed = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
              for c in LISTED]
    answer = F.struct(log_order().alias("order"), "vote")
    return {
        "cells": view.groupBy(*CELL, "version", "vote").agg(
            F.count(F.lit(1)).alias("count"), F.count("elapsed_sec").alias("timed"),
            metrics.exact_sum("elapsed_sec").alias("time")),
        "dimensions": view.select(*CELL, "vote", F.inline(F.array(*named)))
        .where(all_present("value", "vote"))
        .groupBy(*CELL, "dimension", "value", "vote").agg(F.count(F.lit(1)).alias("count")),
        "values": view.select(F.inline(F.array(*listed))).where("value IS NOT NULL").distinct(),
        "personas": view.select("persona_uuid").distinct(),
        "answers": view.groupBy("persona_uuid", "model", "voter_context_version").agg(
            F.min_by(answer, log_order()).alias("first"),
            F.max_by(answer, log_order()).alias("last")),
    }


def merged(parts: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Parts laid under each other, as one part."""
    def added(name: str, *sums: str) -> DataFrame:
        keys = [c for c in SCHEMAS[name].names if c not in sums]
        return parts[name].groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])

    return {
        "cells": added("cells", "count", "timed", "time"),
        "dimensions": added("dimensions", "count"),
        "values": parts["values"].distinct(),
        "personas": parts["personas"].distinct(),
        "answers": parts["answers"].groupBy("persona_uuid", "model", "voter_context_version").agg(
            F.min_by("first", F.col("first.order")).alias("first"),
            F.max_by("last", F.col("last.order")).alias("last")),
    }


def _write(tables: Mapping[str, DataFrame], folder: str, covers: Sequence[str],
           replaces: Sequence[str] = ()) -> None:
    spark, attempt = next(iter(tables.values())).sparkSession, published.new_attempt()

    def job(name: str, table: DataFrame):
        rows = table.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name].fields])
        path = published.part_path(folder, name, attempt, attempt)
        return lambda: rows.hint("rebalance").write.parquet(path)

    at_once(*[job(name, table) for name, table in tables.items()])
    published.publish(spark, folder, attempt, attempt, list(SCHEMAS), covers, replaces)


def refresh(spark: SparkSession, folder: str, fold_at: int = FOLD_AT) -> list[str]:
    """Bring the kept parts up to date; returns the parts of the log that were read.

    Parts that cover a superseded run no longer count. All runs that are then without a part
    become one, from one reading of them.
    """
    kept = f"{folder}/panels"
    live = [published.part_name(r) for r in published.entries(spark, folder) if "log" in r.tables]
    parts = _counted(spark, folder)
    stale = [r for r in parts if not set(r.covers) <= set(live)]
    covered = {name for r in parts if r not in stale for name in r.covers}
    new = sorted(set(live) - covered)
    if new or stale:
        _write(partials(logged(spark, folder, only=new)), kept, new,
               [published.part_name(r) for r in stale])
    if len(parts) - len(stale) + 1 > fold_at:
        fold(spark, folder)
    return new


def fold(spark: SparkSession, folder: str) -> None:
    """Merge all kept parts into one, which stands for them from then on."""
    kept = f"{folder}/panels"
    parts = _counted(spark, folder)
    covers = sorted({name for r in parts for name in r.covers})
    _write(merged(read_parts(spark, folder)), kept, covers,
           [published.part_name(r) for r in parts])


def _counted(spark: SparkSession, folder: str) -> list[Row]:
    """The parts that count: where two refreshes met, the later part that covers a run again
    is left out."""
    taken: set[str] = set()
    parts = []
    for row in sorted(published.entries(spark, f"{folder}/panels"), key=lambda r: r.number):
        if not taken & set(row.covers):
            parts.append(row)
            taken |= set(row.covers)
    return parts


def read_parts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    only = [published.part_name(r) for r in _counted(spark, folder)]
    return {name: published.read_table(spark, f"{folder}/panels", name, schema, only=only)
            for name, schema in SCHEMAS.items()}


def dashboard(parts: Mapping[str, DataFrame],
              selected: Mapping[str, Sequence | None] | None = None) -> dict[str, DataFrame]:
    """The counted tables of the dashboard, from kept parts."""
    tables = merged(parts)
    cells = tables["cells"]
    mean = F.sum("time").cast("double") / F.sum("timed")

    def counted(*keys: str) -> DataFrame:
        return cells.where(all_present(*keys)).groupBy(*keys).agg(F.sum("count").alias("count"))

    def shares(*keys: str) -> DataFrame:
        counts = counted(*keys, "vote")
        totals = counts.groupBy(*keys).agg(F.sum("count").alias("_total"))
        return counts.join(totals, list(keys)).select(
            *keys, "vote", "count", (F.col("count") / F.col("_total") * 100).alias("pct"))

    def latency(*keys: str) -> DataFrame:
        return cells.where(all_present(*keys)).groupBy(*keys).agg(
            mean.alias("mean"), F.sum("timed").alias("count"))

    chosen = where_selected(tables["dimensions"], {**dict.fromkeys(CELL), **(selected or {})})
    given = where_selected(cells, {**dict.fromkeys(CELL), **(selected or {})})

    def crossed(dimension: str, labels: Sequence[str] | None = None) -> DataFrame:
        counts = (
            chosen.where(F.col("dimension") == dimension)
            .groupBy(F.col("value").alias(dimension), "vote").agg(F.sum("count").alias("count")))
        if labels is None:
            return counts
        answers = given.where(F.col("vote").isNotNull()).select("vote").distinct()
        pairs = answers.select(F.explode(F.array(*map(F.lit, labels))).alias(dimension), "vote")
        return pairs.join(counts, [dimension, "vote"], "left").select(
            dimension, "vote", F.coalesce("count", F.lit(0)).alias("count"))

    personas = tables["personas"].agg(F.count("persona_uuid")).scalar()
    return {
        "kpi": cells.agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"),
            F.countDistinct("model").alias("n_models"), mean.alias("mean_latency"),
        ).withColumn("n_personas", personas),
        "share_by_model": shares("model"),
        "share_by_model_version": shares("model", "version"),
        "latency_by_model": latency("model"),
        "latency_by_model_version": latency("model", "version"),
        "by_age": crossed("age_bucket", fv.AGE_LABELS),
        "by_province": crossed("province"),
        "by_sex": crossed("sex"),
        "options": tables["values"].orderBy("column", "value"),
        "version_pairs": cells.where("voter_context_version IS NOT NULL").select(
            "voter_context_version", "system_prompt_version").distinct(),
    }


def comparison(parts: Mapping[str, DataFrame], cells: Mapping[str, tuple[str, str]],
               pair: tuple[str, str], keep: str = "last") -> dict[str, DataFrame]:
    """The counted tables of the comparison page, from each persona's kept answers."""
    state = F.col(keep)
    rows = merged(parts)["answers"].select(
        "persona_uuid", "model", "voter_context_version", state["vote"].alias("vote"),
        state["order"].alias("order"))
    answers = compare.wide_compare(rows, cells, F.col("order"), values=("vote",), keep=keep,
                                   base=next(iter(cells)))
    before, after = (f"vote_{name}" for name in pair)
    both = complete(answers, before, after)
    return {
        "answers": answers,
        "answered": metrics.non_null_counts(answers, [f"vote_{name}" for name in cells]),
        "change": compare.change_rate(answers, before, after),
        "transitions": compare.transition_matrix(both, before, after),
        **{f"distribution_{name}": metrics.share_of_total(
            both if name in pair else answers, f"vote_{name}") for name in cells},
    }
