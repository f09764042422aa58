"""Panels brought up to date run by run, and joins over tables laid out by persona."""

import uuid

from pyspark.sql import functions as F

from panelkit.plans import refresh, runs
from panelkit.queries.base import CELLS, log, query, table
from panelkit.queries.runs import COMPARED, PAGE_LOG, _response_log
from panelkit.runtime import new_folder
from panelkit.sources import laid_out

PARTS = 2
MODEL, VERSION = "m/a", "v2"


def _kept(spark, folder):
    """The events as runs, the panels refreshed after each, and a run that is recorded again."""
    out, rows = new_folder(spark, "kept"), _response_log(spark, folder)
    part = F.pmod(F.xxhash64("response_file"), F.lit(PARTS))
    for k in [*range(PARTS), 0]:
        runs.import_log(rows.where(part == k), out, f"run-{k}")
        refresh.refresh(spark, out, fold_at=1)
    return refresh.read_parts(spark, out)


@query(f"""WITH {PAGE_LOG} SELECT model, version, vote, count(*) AS count,
  count(*) / CAST(sum(count(*)) OVER (PARTITION BY model, version) AS DOUBLE) * 100 AS pct
FROM (SELECT model, coalesce(version, '?') AS version, vote FROM page)
WHERE vote IS NOT NULL GROUP BY 1, 2, 3""")
def kept_share(spark, folder):
    return refresh.dashboard(_kept(spark, folder))["share_by_model_version"]


@query(f"""WITH {PAGE_LOG} SELECT count(*) AS n_rows, count(DISTINCT model) AS n_models,
  round(avg(elapsed_sec), 9) AS mean_latency, count(DISTINCT persona_uuid) AS n_personas
FROM page""")
def kept_kpi(spark, folder):
    return refresh.dashboard(_kept(spark, folder))["kpi"].withColumn(
        "mean_latency", F.round("mean_latency", 9))


@query(f"""{COMPARED} SELECT count(*) AS n_pairs,
  count(*) FILTER (WHERE vote_v2 <> vote_v3) AS n_changed,
  count(*) FILTER (WHERE vote_v2 <> vote_v3) / CAST(count(*) AS DOUBLE) * 100 AS pct_changed
FROM w WHERE vote_v2 IS NOT NULL AND vote_v3 IS NOT NULL""")
def kept_change(spark, folder):
    return refresh.comparison(_kept(spark, folder), CELLS, ("v2", "v3"))["change"]


def _laid_out(spark, folder):
    """The customers and the events as tables in buckets of one number."""
    name = f"t{uuid.uuid4().hex}"
    people = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("persona_uuid"), F.col("c_name").alias("name"))
    events = log(spark, folder).select(
        F.col("persona").alias("persona_uuid"), "model",
        F.col("version").alias("voter_context_version"), "vote")
    for part, rows in (("panel", people), ("log", events)):
        laid_out.write_laid_out(rows, f"{name}_{part}", buckets=8,
                                path=new_folder(spark, f"laid-out-{part}"))
    return tuple(laid_out.read_laid_out(spark, f"{name}_{part}") for part in ("panel", "log"))


DONE = f"""SELECT DISTINCT user_id FROM events
WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 AND day(ts) <= 10"""


@query(f"""SELECT c_custkey AS persona_uuid, c_name AS name FROM customer
WHERE c_custkey NOT IN ({DONE})""")
def laid_out_todo(spark, folder):
    return laid_out.unanswered(*_laid_out(spark, folder), MODEL, VERSION)


@query(f"""SELECT c_custkey AS persona_uuid, c_name AS name FROM customer
WHERE c_custkey IN ({DONE})""")
def laid_out_cohort(spark, folder):
    return laid_out.answered(*_laid_out(spark, folder), MODEL, VERSION)
