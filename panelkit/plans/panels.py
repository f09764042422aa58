"""The dashboard and comparison pages as tables, each a lazy DataFrame."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit import fixed_values as fv
from panelkit import schemas
from panelkit.functions.columns import (
    bucket, facets as unpivot_facets, log_order, lookup, tenths_text, with_default_version)
from panelkit.functions.render import profile_line
from panelkit.operators import compare, metrics, sets
from panelkit.operators.filters import changed, complete, unchanged, where_any_of, where_selected
from panelkit.operators.joins import enrich
from panelkit.operators.sampling import recent

PROFILE = (*schemas.DEMOGRAPHICS, "persona_summary")
RAW_VIEW, FACETS = fv.RAW_VIEW, fv.FACETS


def log_view(log: DataFrame) -> DataFrame:
    """The log with its age band and a version that is never null."""
    return log.withColumns({
        "age_bucket": bucket("age"), "version": with_default_version("voter_context_version")})


def dashboard(log: DataFrame, selected: Mapping[str, Sequence | None] | None = None,
              facets: Mapping[str, Sequence] | None = None, n_recent: int = 10
              ) -> dict[str, DataFrame]:
    """Every panel of the dashboard.

    ``selected`` narrows the cross counts (model and the two versions, all options by
    default), ``facets`` the feed (an empty list is no filter).
    """
    view = log_view(log)
    chosen = where_selected(view, {
        "model": None, "voter_context_version": None, "system_prompt_version": None,
        **(selected or {})})
    filtered = where_any_of(view, facets or {})
    feed = recent(filtered, ["response_file", "persona_uuid"], n_recent)
    total = view.agg(F.count(F.lit(1))).scalar()
    return {
        "kpi": metrics.kpi(log),
        "share_by_model": metrics.share_of_group(view, ["model"], "vote"),
        "share_by_model_version": metrics.share_of_group(view, ["model", "version"], "vote"),
        "latency_by_model": metrics.mean_count(view, ["model"]),
        "latency_by_model_version": metrics.mean_count(view, ["model", "version"]),
        "by_age": metrics.cross_count(chosen, "age_bucket", "vote", fv.AGE_LABELS),
        "by_province": metrics.cross_count(chosen, "province", "vote"),
        "by_sex": metrics.cross_count(chosen, "sex", "vote"),
        "options": sets.filter_options(
            log, [*FACETS, "model", "voter_context_version", "system_prompt_version"]),
        "version_pairs": log.where(F.col("voter_context_version").isNotNull()).select(
            "voter_context_version", "system_prompt_version").distinct(),
        "feed": feed.withColumns({
            "color": lookup("vote"), "latency": tenths_text("elapsed_sec"),
            "profile": profile_line()}),
        "feed_facets": unpivot_facets(feed, ["response_file", "persona_uuid"]),
        "counts": filtered.agg(F.count(F.lit(1)).alias("n_filtered")).withColumn(
            "n_rows", total),
        "raw": log.select(*RAW_VIEW),
    }


def comparison(log: DataFrame, cells: Mapping[str, tuple[str, str]], interests: DataFrame,
               pair: tuple[str, str], show: str = "all",
               choices: Mapping[str, Sequence] | None = None) -> dict[str, DataFrame]:
    """The comparison page: the wide table, its counts, the changes of one pair of cells.

    ``show`` is ``all``, ``changed`` or ``kept`` and ``choices`` maps columns of the wide
    table to wanted values; both narrow ``view`` and ``view_counts`` only. Cells of the
    pair are counted over the personas that answered in both.
    """
    base = next(iter(cells))
    wide = enrich(
        compare.wide_compare(log, cells, log_order(), base=base, base_columns=PROFILE), interests)
    # Counts need the answers alone; notes and reasons are not carried there.
    answers = compare.wide_compare(log, cells, log_order(), base=base, values=("vote",))
    before, after = (f"vote_{name}" for name in pair)
    both = complete(answers, before, after)
    votes = [f"vote_{name}" for name in cells]
    kept = {"all": F.lit(True), "changed": changed(before, after),
            "kept": unchanged(before, after)}[show]
    view = where_any_of(wide, choices or {}).where(kept)
    total = answers.agg(F.count(F.lit(1))).scalar()
    return {
        "wide": wide,
        "view": view,
        "view_counts": view.agg(F.count(F.lit(1)).alias("n_shown")).withColumn(
            "n_personas", total),
        "answered": metrics.non_null_counts(wide, [*votes, "political_interest"]),
        "change": compare.change_rate(answers, before, after),
        "transitions": compare.transition_matrix(both, before, after),
        **{f"distribution_{name}": metrics.share_of_total(
            both if name in pair else answers, f"vote_{name}") for name in cells},
        "options": sets.filter_options(wide, [before, after, "province", "sex"]),
    }
