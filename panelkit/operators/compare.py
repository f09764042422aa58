"""Answers of the same personas side by side: wide tables, changes, transitions."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.dedupe import keep_first, keep_last
from panelkit.operators.filters import changed, complete
from panelkit.operators.metrics import group_size

Cell = tuple[str, str]


def _in_cells(df: DataFrame, cells: Sequence[Cell], model: str, version: str) -> DataFrame:
    """Rows of the cells. Plain ``isin`` tests go along, for the scan to prune by."""
    exact = F.lit(False)
    for m, v in cells:
        exact = exact | ((F.col(model) == m) & (F.col(version) == v))
    return df.where(
        F.col(model).isin(sorted({m for m, _ in cells}))
        & F.col(version).isin(sorted({v for _, v in cells})) & exact
    )


def wide_compare(df: DataFrame, cells: Mapping[str, Cell], order: Column,
                 persona: str = "persona_uuid", model: str = "model",
                 version: str = "voter_context_version",
                 values: Sequence[str] = ("vote", "reason"), keep: str = "last",
                 base: str | None = None, base_columns: Sequence[str] = (),
                 present: Sequence[str] = ()) -> DataFrame:
    """One row per persona with ``{value}_{cell}`` columns for each (model, version) cell.

    Each cell contributes its last (or first) row by ``order``. With ``base``, only
    personas of that cell stay, as after a chain of left joins, and
    ``base_columns`` come from its row; without it personas of any cell stay, as
    after outer joins. ``present`` names cells in which a persona must have a row,
    whatever it answered, as after inner joins. It is always one aggregation: one
    shuffle, rows combined before it, whatever the number of cells.
    """
    pick = {"last": F.max_by, "first": F.min_by}[keep]
    rows = _in_cells(df, list(cells.values()), model, version)

    def cell_row(name: str, columns: Sequence[str]) -> Column:
        m, v = cells[name]
        hit = (F.col(model) == m) & (F.col(version) == v)
        return pick(F.when(hit, F.struct(*columns)), F.when(hit, order))

    picked = rows.groupBy(persona).agg(*[
        cell_row(name, [*values, *(base_columns if name == base else ())]).alias(f"_{name}")
        for name in cells
    ])
    for name in {*present, *([base] if base is not None else [])}:
        picked = picked.where(F.col(f"_{name}").isNotNull())
    return picked.select(
        persona,
        *[F.col(f"_{base}.{c}") for c in base_columns],
        *[F.col(f"_{name}.{v}").alias(f"{v}_{name}") for name in cells for v in values],
    )


def inner_pair(df: DataFrame, first: tuple[str, Cell], second: tuple[str, Cell], order: Column,
               keep: str = "first", **names) -> DataFrame:
    """Personas with a row in both cells, with the two answers, null ones included."""
    return wide_compare(df, dict([first, second]), order, keep=keep,
                        present=(first[0], second[0]), **names)


def change_rate(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Personas with both answers, how many changed, and the percentage."""
    moved = F.count_if(changed(before, after))
    return complete(pairs, before, after).agg(
        F.count(F.lit(1)).alias("n_pairs"), moved.alias("n_changed"),
        (moved / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100).alias("pct_changed"),
    )


def transition_cube(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Counts per (before, after) and their totals, told apart by two flags.

    The pairs are counted first, so the four grouping sets expand the few counted rows
    and not the personas.
    """
    counts = group_size(pairs, [before, after])
    return counts.cube(before, after).agg(
        F.sum("count").alias("count"),
        (F.grouping(before) == 1).alias("all_before"),
        (F.grouping(after) == 1).alias("all_after"),
    )


def _labelled(column: str, is_total: str, total: str) -> Column:
    """The answer, or the name of the total; an answer of that name stops the query."""
    clash = F.raise_error(F.lit(f"an answer is called {total!r}: choose another total name"))
    return (
        F.when(F.col(is_total), total).when(F.col(column) == total, clash.cast("string"))
        .otherwise(F.col(column)).alias(column)
    )


def transition_matrix(pairs: DataFrame, before: str, after: str, total: str = "All") -> DataFrame:
    """Counts per (before, after) with row, column and grand totals named ``total``."""
    return transition_cube(pairs, before, after).select(
        _labelled(before, "all_before", total), _labelled(after, "all_after", total), "count")


def transition_table(pairs: DataFrame, before: str, after: str, answers: Sequence[str],
                     total: str = "All", other: str = "(other)") -> DataFrame:
    """The transition matrix with one column per listed answer; absent cells are 0.

    Answers that are not listed are counted in the column ``other``, so the columns of a
    row sum to its total.
    """
    if {total, other} & set(answers):
        raise ValueError("the total and the other column need names of their own")
    each = F.col("all_after") == F.lit(False)
    listed = F.col(after).isin(list(answers))

    def summed(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0))

    # Answers become column names, so the rows' own column is named last.
    counted = (
        transition_cube(pairs, before, after)
        .withColumn("_row", _labelled(before, "all_before", total)).groupBy("_row")
        .agg(*[summed(each & (F.col(after) == a)).alias(f"_{i}") for i, a in enumerate(answers)],
             summed(each & ~listed).alias("_other"), summed(F.col("all_after")).alias("_total"))
    )
    return counted.select(
        F.col("_row").alias(before),
        *[F.col(f"_{i}").alias(a) for i, a in enumerate(answers)],
        F.col("_other").alias(other), F.col("_total").alias(total))


def cell_distributions(df: DataFrame, cells: Sequence[Cell], order: Column, vote: str = "vote",
                       persona: str = "persona_uuid", model: str = "model",
                       version: str = "voter_context_version", keep: str = "last") -> DataFrame:
    """Answer counts of each cell over one row per persona; cells without rows are absent."""
    kept = {"last": keep_last, "first": keep_first}[keep](
        _in_cells(df, cells, model, version).select(
            persona, model, version, vote, order.alias("_order")),
        [persona, model, version], F.col("_order"),
    )
    return group_size(kept, [model, version, vote])
