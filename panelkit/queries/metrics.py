"""Counts, shares, latency and rates."""

from pyspark.sql import functions as F

from panelkit.functions.columns import bucket, round_half_even, tenths_text, with_default_version
from panelkit.operators import metrics
from panelkit.queries.base import LOG, log, query, table

BALANCE_EDGES = (-1000, 0, 2500, 5000, 7500, 20000, 50000)
BALANCE_LABELS = ("debt", "low", "middle", "high", "top", "beyond")


def _finer(spark, folder):
    """The log with latencies of more than three decimals, some far below a millisecond."""
    return log(spark, folder).withColumn("elapsed_sec", F.col("elapsed_sec") / 70000)


@query(f"""WITH {LOG}
SELECT count(*) AS n_rows, count(DISTINCT model) AS n_models,
       round(avg(elapsed_sec / 70000), 12) AS mean_latency, count(DISTINCT persona) AS n_personas
FROM log""")
def kpi_summary(spark, folder):
    return metrics.kpi(_finer(spark, folder), persona="persona").withColumn(
        "mean_latency", F.round("mean_latency", 12))


@query("""WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders
  WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2)
SELECT o_orderpriority, o_orderstatus, n AS count,
       n / CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS DOUBLE) * 100 AS pct
FROM c""")
def share_by_group(spark, folder):
    orders = table(spark, folder, "orders")
    return metrics.share_of_group(orders, ["o_orderpriority"], "o_orderstatus")


@query(f"""WITH {LOG}, c AS (
  SELECT model, coalesce(version, '?') AS version, vote, count(*) AS n FROM log
  WHERE vote IS NOT NULL GROUP BY 1, 2, 3)
SELECT model, version, vote, n AS count,
       n / CAST(sum(n) OVER (PARTITION BY model, version) AS DOUBLE) * 100 AS pct
FROM c""")
def share_by_group_version(spark, folder):
    view = log(spark, folder).withColumn("version", with_default_version("version"))
    return metrics.share_of_group(view, ["model", "version"], "vote")


@query(f"""WITH {LOG}
SELECT model, round(avg(elapsed_sec / 70000), 12) AS mean, count(elapsed_sec) AS count
FROM log GROUP BY 1""")
def latency_by_group(spark, folder):
    return metrics.mean_count(_finer(spark, folder), ["model"]).withColumn(
        "mean", F.round("mean", 12))


@query(f"""WITH {LOG}
SELECT model, version,
       round(avg(elapsed_sec), 9) AS mean, count(elapsed_sec) AS count
FROM log WHERE version IS NOT NULL GROUP BY 1, 2""")
def latency_by_group_version(spark, folder):
    return metrics.mean_count(log(spark, folder), ["model", "version"]).withColumn(
        "mean", F.round("mean", 9))


@query("""SELECT CASE WHEN p_size > 0 AND p_size <= 29 THEN '20대'
       WHEN p_size > 29 AND p_size <= 39 THEN '30대'
       WHEN p_size > 39 AND p_size <= 49 THEN '40대'
       WHEN p_size > 49 AND p_size <= 59 THEN '50대'
       WHEN p_size > 59 AND p_size <= 69 THEN '60대'
       WHEN p_size > 69 AND p_size <= 200 THEN '70+' END AS age_bucket, p_type, count(*) AS count
FROM part GROUP BY 1, 2 HAVING age_bucket IS NOT NULL AND p_type IS NOT NULL""")
def bucket_crosstab(spark, folder):
    part = table(spark, folder, "part").withColumn("age_bucket", bucket("p_size"))
    return metrics.cross_count(part, "age_bucket", "p_type")


@query("""WITH b AS (SELECT
       CASE WHEN c_acctbal > 9900 THEN 'RICH' ELSE c_mktsegment END AS c_mktsegment, CASE
       WHEN c_acctbal > 9900 THEN NULL WHEN c_acctbal > -1000 AND c_acctbal <= 0 THEN 'debt'
       WHEN c_acctbal > 0 AND c_acctbal <= 2500 THEN 'low'
       WHEN c_acctbal > 2500 AND c_acctbal <= 5000 THEN 'middle'
       WHEN c_acctbal > 5000 AND c_acctbal <= 7500 THEN 'high'
       WHEN c_acctbal > 7500 AND c_acctbal <= 20000 THEN 'top'
       WHEN c_acctbal > 20000 AND c_acctbal <= 50000 THEN 'beyond' END AS band FROM customer),
c AS (SELECT band, c_mktsegment, count(*) AS n FROM b
      WHERE band IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1, 2),
g AS (SELECT l.band, s.c_mktsegment
      FROM (VALUES ('debt'), ('low'), ('middle'), ('high'), ('top'), ('beyond')) l(band),
           (SELECT DISTINCT c_mktsegment FROM b WHERE c_mktsegment IS NOT NULL) s)
SELECT g.band, g.c_mktsegment, coalesce(c.n, 0) AS count
FROM g LEFT JOIN c ON g.band = c.band AND g.c_mktsegment = c.c_mktsegment""")
def bucket_crosstab_dense(spark, folder):
    # One answer occurs outside all bands only; its cells are all 0.
    rich = F.col("c_acctbal") > 9900
    customer = table(spark, folder, "customer").withColumns({
        "band": F.when(~rich, bucket("c_acctbal", BALANCE_EDGES, BALANCE_LABELS)),
        "c_mktsegment": F.when(rich, "RICH").otherwise(F.col("c_mktsegment"))})
    return metrics.cross_count(customer, "band", "c_mktsegment", BALANCE_LABELS)


@query(f"""WITH {LOG}
SELECT vote, count(*) AS count FROM log WHERE vote IS NOT NULL GROUP BY 1
ORDER BY count DESC, vote""")
def value_counts(spark, folder):
    return metrics.value_counts(log(spark, folder), "vote")


@query(f"""WITH {LOG}, c AS (SELECT vote, count(*) AS n FROM log WHERE vote IS NOT NULL GROUP BY 1)
SELECT vote, n AS count, n / (SELECT CAST(sum(n) AS DOUBLE) FROM c) * 100 AS pct,
       n / (SELECT CAST(max(n) AS DOUBLE) FROM c) * 100 AS bar_pct
FROM c""")
def share_of_total_and_max(spark, folder):
    return metrics.share_of_total(log(spark, folder), "vote")


@query(f"""WITH {LOG} SELECT count(persona) AS persona, count(version) AS version,
       count(vote) AS vote FROM log""")
def answered_counts(spark, folder):
    return metrics.non_null_counts(log(spark, folder), ["persona", "version", "vote"])


@query("""SELECT event_id, value, printf('%.1f', value) AS shown,
       round_even(value * 10, 0) / 10 AS rounded FROM events""")
def latency_text(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", "value", tenths_text("value").alias("shown"),
        round_half_even("value", 1).alias("rounded"))


@query("""SELECT o_orderpriority, count(*) AS attempts,
       CAST(count(*) FILTER (WHERE o_orderstatus <> 'P') AS BIGINT) AS successes,
       count(*) FILTER (WHERE o_orderstatus <> 'P') / CAST(count(*) AS DOUBLE) AS rate
FROM orders GROUP BY 1""")
def success_rate(spark, folder):
    orders = table(spark, folder, "orders")
    pending = F.col("o_orderstatus") == "P"
    return metrics.success_rate(orders.where(~pending), orders.where(pending), ["o_orderpriority"])
