"""The streaming forms over the events, cut into files that come as batches of their own."""

from pyspark.sql import functions as F

from panelkit.queries.base import LOG, query, table
from panelkit.runtime import new_folder
from panelkit.streaming import live


BATCHES = 3


def _stream(spark, folder):
    """The events as a stream of response rows: one file, and so one batch, after another."""
    given, path = table(spark, folder, "events"), new_folder(spark, "events")
    given.repartition(BATCHES, F.pmod("event_id", F.lit(BATCHES))).write.parquet(path)
    events = live.read_stream(spark, path, given.schema, maxFilesPerTrigger=1)
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.dayofmonth("ts")
    return events.select(
        "event_id", "ts", F.col("user_id").alias("persona"), F.col("event_type").alias("vote"),
        F.col("value").alias("elapsed_sec"),
        F.when(k < 50, "m/a").otherwise("m/b").alias("model"),
        F.when(day <= 10, "v2").when(day <= 20, "v3").when(day <= 29, "v10").alias("version"),
    )


def _run(spark, start):
    out = new_folder(spark, "stream")
    start(f"{out}/table", f"{out}/state").awaitTermination()
    return f"{out}/table"


@query(f"""WITH {LOG} SELECT model, vote, count(*) AS count,
  round(avg(elapsed_sec), 9) AS mean
FROM log GROUP BY 1, 2""")
def stream_totals(spark, folder):
    stream = _stream(spark, folder)
    return live.read_totals(spark, _run(spark, lambda path, state: live.live_totals(
        stream, ["model", "vote"], path, state, refresh=None))).withColumn(
        "mean", F.round("mean", 9))


@query(f"""WITH {LOG} SELECT 'model' AS "column", count(DISTINCT model) AS n_distinct FROM log
UNION ALL SELECT 'persona', count(DISTINCT persona) FROM log""")
def stream_distinct(spark, folder):
    stream = _stream(spark, folder)
    return live.read_distinct(spark, _run(spark, lambda path, state: live.live_distinct(
        stream, ["model", "persona"], path, state, refresh=None)))


@query(f"""WITH {LOG}, r AS (SELECT *, row_number() OVER (
  PARTITION BY persona, model, version ORDER BY ts DESC, event_id DESC) AS rn FROM log)
SELECT persona, model, version, event_id, ts, vote, elapsed_sec FROM r WHERE rn = 1""")
def stream_latest(spark, folder):
    stream, keys = _stream(spark, folder), ["persona", "model", "version"]
    order = F.struct("ts", "event_id")
    path = _run(spark, lambda path, state: live.live_latest(
        stream, keys, order, path, state, refresh=None, width=2))
    return live.read_latest(spark, path, keys, stream.schema, order).select(
        *keys, "event_id", "ts", "vote", "elapsed_sec")


@query(f"""WITH {LOG} SELECT event_id, ts, persona, vote, elapsed_sec, model, version FROM log""")
def stream_ingest(spark, folder):
    stream = _stream(spark, folder)
    path = _run(spark, lambda path, state: live.ingest(stream, path, state, refresh=None))
    return spark.read.parquet(path).drop("batch")
