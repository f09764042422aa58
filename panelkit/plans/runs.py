"""Whole runs: sample or take a cohort, render, ask, store, parse, append."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit import fixed_values as fv
from panelkit import schemas
from panelkit.functions.columns import key_prefix, log_order, response_name, safe_name
from panelkit.functions.parse import parse_replies, split_replies
from panelkit.functions.render import card, fill_template, user_message
from panelkit.operators.dedupe import keep_first
from panelkit.operators.filters import where_equal
from panelkit.operators.infer import ADDED, KEEP_EVERY, Factory, keep_replies
from panelkit.operators.joins import attach_by_version, enrich, not_done
from panelkit.operators.metrics import run_summary
from panelkit.operators.sampling import run_grid
from panelkit.runtime import at_once
from panelkit.sources import published
from panelkit.sources.readers import read_or_empty
from panelkit.sources.sinks import append_log, write_dead_letters, write_documents, write_summary


def system_texts(assets: DataFrame) -> DataFrame:
    """(version, system_text): each version's context filled into its system prompt.

    Filled here, once per version, and not once per asked row.
    """
    def text(kind: str, name: str) -> DataFrame:
        return assets.where(F.col("kind") == kind).select("version", F.col("text").alias(name))

    pairs = text("system_prompt", "_template").join(text("voter_context", "_context"), "version")
    return pairs.select(
        "version",
        fill_template("_template", {fv.CONTEXT_SLOT: F.col("_context")}).alias("system_text"),
    )


def prompt_rows(targets: DataFrame, assets: DataFrame, interest: str | None = None) -> DataFrame:
    """Targets (profile, model, version) with ``system_text`` and ``user_text``."""
    texts = attach_by_version(targets, system_texts(assets))
    return texts.withColumn("user_text", user_message("model", card(interest=interest)))


KEYS = ("persona_uuid", "model", "version")
TABLES = ("log", "documents", "dead_letters", "summary")


def ask(targets: DataFrame, factory: Factory, store: str, prepare, tasks: int = 8,
        calls_at_once: int = 1, keep_every: int = KEEP_EVERY) -> DataFrame:
    """Ask the targets that the store has no reply for, and return all stored replies.

    Replies cost money and differ per call, so the workers keep them as they come. What a
    failed run has kept is not asked again, whether it or its worker died, and targets
    added under the same store are asked. All targets are one job of ``tasks`` tasks.
    """
    spark = targets.sparkSession
    todo = not_done(targets, stored_replies(spark, store), list(KEYS))
    keep_replies(todo, factory, f"{store}/kept", KEYS, buckets=tasks, prepare=prepare,
                 at_once=calls_at_once, keep_every=keep_every).write.format("noop").mode(
        "overwrite").save()
    return stored_replies(spark, store)


def stored_replies(spark: SparkSession, store: str) -> DataFrame:
    """The kept replies of a store, one per target; empty if there are none.

    Where two attempts kept a row, the first reply counts. Only keys are shuffled to find
    such rows; replies stay in place.
    """
    empty = T.StructType([*(T.StructField(n, T.StringType()) for n in KEYS), *ADDED])
    rows = read_or_empty(spark, f"{store}/kept", empty, lambda s, p: s.read.parquet(p))
    if "bucket" not in rows.columns:
        return rows
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    order = F.struct("timestamp", "_file", "_at")
    again = (
        rows.select(*KEYS, "timestamp", *place).groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"),
             F.collect_list(F.struct("_file", "_at")).alias("_all")).where("_n > 1"))
    later = again.select("_first", F.explode("_all").alias("_one")).where(
        (F.col("_one._file") != F.col("_first._file"))
        | (F.col("_one._at") != F.col("_first._at"))).select("_one.*")
    return rows.select(*rows.columns, *place).join(later, ["_file", "_at"], "left_anti").drop(
        "_file", "_at", "bucket")


def record(replies: DataFrame, folder: str, run: str, control_chars: bool = False) -> DataFrame:
    """Parse the stored replies of a run and show its tables; returns the summary.

    ``folder`` holds ``log``, ``documents``, ``dead_letters`` and ``summary``, each with
    one part per run. The parsed rows are written once, as ``parsed``, the four tables
    are cut from them, and the manifest shows all four in one step. Recording a run again
    replaces its parts in the same way.
    """
    parsed = (
        parse_replies(replies, control_chars=control_chars)
        .withColumn("response_file",
                    response_name("timestamp", "model", "persona_uuid", "version"))
        .withColumn("voter_context_version", F.col("version"))
        .withColumn("system_prompt_version", F.col("version"))
    )
    spark, attempt = replies.sparkSession, published.new_attempt()
    stored = published.part_path(folder, "parsed", run, attempt)
    parsed.write.parquet(stored)
    parsed = spark.read.schema(parsed.schema).parquet(stored)
    good, bad = split_replies(parsed)
    failed_name = F.concat(F.lit("FAIL_"), F.concat_ws(
        "_", "timestamp", safe_name("model"), key_prefix("persona_uuid"), "version"),
        F.lit(".txt"))
    summary = run_summary(parsed, ["model", "version"])
    at_once(
        lambda: append_log(good, f"{folder}/log", run, attempt=attempt),
        lambda: write_documents(good, f"{folder}/documents", run, attempt),
        lambda: write_dead_letters(
            bad.withColumn("file_name", failed_name), f"{folder}/dead_letters", run, attempt),
        lambda: write_summary(summary, f"{folder}/summary", run, attempt))
    published.publish(spark, folder, run, attempt, TABLES)
    return summary


def import_log(rows: DataFrame, folder: str, run: str) -> None:
    """Add answered rows from elsewhere, such as an old CSV log, as a run of their own."""
    attempt = published.new_attempt()
    append_log(rows, f"{folder}/log", run, attempt=attempt)
    published.publish(rows.sparkSession, folder, run, attempt, ["log"])


def logged(spark: SparkSession, folder: str, only: Sequence[str] | None = None) -> DataFrame:
    """The log of all recorded runs, or of the parts in ``only``."""
    return published.read_table(spark, folder, "log", schemas.RESPONSE_LOG, only=only)


def failed(spark: SparkSession, folder: str) -> DataFrame:
    """The dead letters of all recorded runs."""
    return published.read_table(spark, folder, "dead_letters", schemas.DEAD_LETTER)


def documented(spark: SparkSession, folder: str) -> DataFrame:
    """The response documents of all recorded runs."""
    return published.read_table(spark, folder, "documents", schemas.RESPONSE_DOCUMENT,
                                reader=lambda source, paths: source.json(paths))


def profile_rows(personas: DataFrame) -> DataFrame:
    """Panel rows under the log's names."""
    return personas.withColumnsRenamed({"uuid": "persona_uuid", "persona": "persona_summary"})


def _unanswered(spark: SparkSession, targets: DataFrame, folder: str) -> DataFrame:
    done = logged(spark, folder).select(
        "persona_uuid", "model", F.col("voter_context_version").alias("version"))
    return not_done(targets, done, ["persona_uuid", "model", "version"])


def sample_run(personas: DataFrame, assets: DataFrame, cells: Sequence[tuple[str, str, int]],
               factory: Factory, folder: str, run: str, seed: int = 0,
               tasks: int = 8) -> DataFrame:
    """Sample the panel per (model, version, count) cell, ask, and append to the log.

    Personas that a cell has in the log are not asked again. A run that was interrupted, or
    whose grid has grown, is started again under its own name.
    """
    targets = run_grid(profile_rows(personas), "persona_uuid", cells, seed)
    todo = _unanswered(personas.sparkSession, targets, folder)
    replies = ask(todo, factory, f"{folder}/replies/{run}",
                  lambda rows: prompt_rows(rows, assets), tasks)
    return record(replies, folder, run)


def cohort_run(spark: SparkSession, assets: DataFrame, base: tuple[str, str],
               target: tuple[str, str], factory: Factory, folder: str, run: str,
               interests: DataFrame | None = None, tasks: int = 8) -> DataFrame:
    """Ask the personas of one (model, version) cell again under another.

    ``interests`` adds each persona's note to its card. Personas already answered
    under the target are left out.
    """
    log = logged(spark, folder)
    profile = ["persona_uuid", *schemas.DEMOGRAPHICS, "persona_summary", *schemas.NARRATIVES]
    members = keep_first(
        where_equal(log, model=base[0], voter_context_version=base[1])
        .select(*profile, log_order().alias("_order")), ["persona_uuid"], F.col("_order"))
    targets = members.drop("_order").withColumns({"model": F.lit(target[0]), "version": F.lit(target[1])})
    todo = _unanswered(spark, targets, folder)
    if interests is not None:
        todo = enrich(todo, interests)
    note = "political_interest" if interests is not None else None
    replies = ask(todo, factory, f"{folder}/replies/{run}",
                  lambda rows: prompt_rows(rows, assets, note), tasks)
    return record(replies, folder, run)
