"""Row filters on the response log. All become plain predicates the scan can push down."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.columns import _col, all_present


def where_equal(df: DataFrame, **values: object) -> DataFrame:
    """Every named column equals its value; nulls never match."""
    for name, value in values.items():
        df = df.where(F.col(name) == value)
    return df


def where_any_of(df: DataFrame, choices: Mapping[str, Sequence]) -> DataFrame:
    """Each column is among its choices; an empty list of choices keeps everything."""
    for name, values in choices.items():
        if values:
            df = df.where(F.col(name).isin(list(values)))
    return df


def where_selected(df: DataFrame, choices: Mapping[str, Sequence | None]) -> DataFrame:
    """Each column is among its selected options; an empty list keeps nothing.

    ``None`` stands for the full default selection, every option that occurs.
    Null is not an option, so null rows go in either case, unless the column has
    no option at all: then there is nothing to select and it is not filtered.
    """
    kept = df
    for name, values in choices.items():
        if values is None:
            # One non-null value settles it, so the probe stops at the first it meets.
            option = df.where(F.col(name).isNotNull()).select(F.lit(True)).limit(1).scalar()
            kept = kept.where(F.col(name).isNotNull() | option.isNull())
        else:
            kept = kept.where(F.col(name).isin(list(values)))
    return kept


def changed(before: Column | str, after: Column | str) -> Column:
    """Both answers are present and differ."""
    before, after = _col(before), _col(after)
    return before.isNotNull() & after.isNotNull() & (before != after)


def unchanged(before: Column | str, after: Column | str) -> Column:
    """Both answers are present and agree."""
    before, after = _col(before), _col(after)
    return before.isNotNull() & after.isNotNull() & (before == after)


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with no null among the columns."""
    return df.where(all_present(*columns))


def version_pair_error(voter: Column | str, system: Column | str) -> Column:
    """An error text for a row whose two versions are not the same, else null."""
    voter, system = _col(voter), _col(system)
    return F.when(
        ~voter.eqNullSafe(system),
        F.concat(F.lit("version pair differs: "), F.coalesce(voter, F.lit("?")),
                 F.lit(" / "), F.coalesce(system, F.lit("?"))),
    )
