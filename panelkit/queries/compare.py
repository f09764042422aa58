"""Deduplication, side-by-side comparison, changes and transitions, joins."""

from pyspark.sql import functions as F

from panelkit.operators import compare, joins, sets
from panelkit.operators.dedupe import keep_first, keep_last
from panelkit.operators.filters import changed, unchanged
from panelkit.queries.base import CELLS, LOG, log, log_order, query, table

NAMES = {"persona": "persona", "version": "version"}
WIDE = f"""WITH {LOG}, cells AS (
  SELECT persona,
    arg_max(vote, row(ts, event_id)) FILTER (WHERE model = 'm/a' AND version = 'v2') AS vote_v2,
    arg_max(elapsed_sec, row(ts, event_id)) FILTER (WHERE model = 'm/a' AND version = 'v2')
      AS elapsed_sec_v2,
    arg_max(vote, row(ts, event_id)) FILTER (WHERE model = 'm/a' AND version = 'v3') AS vote_v3,
    arg_max(elapsed_sec, row(ts, event_id)) FILTER (WHERE model = 'm/a' AND version = 'v3')
      AS elapsed_sec_v3,
    arg_max(vote, row(ts, event_id)) FILTER (WHERE model = 'm/b' AND version = 'v10')
      AS vote_v10_b,
    arg_max(elapsed_sec, row(ts, event_id)) FILTER (WHERE model = 'm/b' AND version = 'v10')
      AS elapsed_sec_v10_b
  FROM log WHERE (model = 'm/a' AND version IN ('v2', 'v3')) OR (model = 'm/b' AND version = 'v10')
  GROUP BY persona)"""


def _wide(spark, folder, **options):
    return compare.wide_compare(
        log(spark, folder), CELLS, log_order(), values=("vote", "elapsed_sec"), **NAMES, **options)


def _kept(order: str) -> str:
    return f"""WITH {LOG}, r AS (
  SELECT *, row_number() OVER (PARTITION BY persona, model ORDER BY ts {order}, event_id {order})
    AS rn FROM log)
SELECT event_id, ts, persona, vote, elapsed_sec, props, model, version FROM r WHERE rn = 1"""


@query(_kept("ASC"))
def dedupe_first(spark, folder):
    return keep_first(log(spark, folder), ["persona", "model"], log_order())


@query(_kept("DESC"))
def dedupe_last(spark, folder):
    return keep_last(log(spark, folder), ["persona", "model"], log_order())


@query(f"{WIDE} SELECT * FROM cells WHERE vote_v2 IS NOT NULL")
def wide_compare_left(spark, folder):
    return _wide(spark, folder, base="v2")


@query(f"{WIDE} SELECT * FROM cells")
def wide_compare_outer(spark, folder):
    return _wide(spark, folder)


@query(f"""WITH {LOG}, r AS (
  SELECT *, row_number() OVER (PARTITION BY persona, version ORDER BY ts, event_id) AS rn
  FROM log WHERE model = 'm/a' AND version IN ('v2', 'v3'))
SELECT a.persona, a.vote AS vote_v2, b.vote AS vote_v3
FROM r a JOIN r b ON a.persona = b.persona AND a.version = 'v2' AND b.version = 'v3'
WHERE a.rn = 1 AND b.rn = 1""")
def inner_pair(spark, folder):
    return compare.inner_pair(
        log(spark, folder), ("v2", CELLS["v2"]), ("v3", CELLS["v3"]), log_order(),
        values=("vote",), **NAMES)


@query(f"""WITH {LOG}, l AS (SELECT * REPLACE (nullif(vote, 'view') AS vote) FROM log), r AS (
  SELECT *, row_number() OVER (PARTITION BY persona, version ORDER BY ts, event_id) AS rn
  FROM l WHERE model = 'm/a' AND version IN ('v2', 'v3'))
SELECT a.persona, a.vote AS vote_v2, b.vote AS vote_v3
FROM r a JOIN r b ON a.persona = b.persona AND a.version = 'v2' AND b.version = 'v3'
WHERE a.rn = 1 AND b.rn = 1""")
def inner_pair_with_nulls(spark, folder):
    answered = log(spark, folder).withColumn("vote", F.nullif("vote", F.lit("view")))
    return compare.inner_pair(
        answered, ("v2", CELLS["v2"]), ("v3", CELLS["v3"]), log_order(), values=("vote",), **NAMES)


@query(f"""{WIDE} SELECT count(*) AS n_pairs,
  count(*) FILTER (WHERE vote_v2 <> vote_v3) AS n_changed,
  count(*) FILTER (WHERE vote_v2 <> vote_v3) / CAST(count(*) AS DOUBLE) * 100 AS pct_changed
FROM cells WHERE vote_v2 IS NOT NULL AND vote_v3 IS NOT NULL""")
def change_rate(spark, folder):
    return compare.change_rate(_wide(spark, folder), "vote_v2", "vote_v3")


@query(f"""{WIDE} SELECT persona, vote_v2, vote_v3, vote_v2 <> vote_v3 AS changed,
  vote_v2 = vote_v3 AS unchanged
FROM cells WHERE vote_v2 IS NOT NULL AND vote_v3 IS NOT NULL""")
def changed_personas(spark, folder):
    is_changed, is_same = changed("vote_v2", "vote_v3"), unchanged("vote_v2", "vote_v3")
    return _wide(spark, folder).where(is_changed | is_same).select(
        "persona", "vote_v2", "vote_v3", is_changed.alias("changed"), is_same.alias("unchanged"))


@query(f"""{WIDE} SELECT CASE WHEN grouping(vote_v2) = 1 THEN 'All' ELSE vote_v2 END AS vote_v2,
  CASE WHEN grouping(vote_v3) = 1 THEN 'All' ELSE vote_v3 END AS vote_v3, count(*) AS count
FROM cells WHERE vote_v2 IS NOT NULL AND vote_v3 IS NOT NULL GROUP BY CUBE (vote_v2, vote_v3)""")
def transition_matrix(spark, folder):
    return compare.transition_matrix(_wide(spark, folder), "vote_v2", "vote_v3")


def _column(vote: str) -> str:
    return f"count(*) FILTER (WHERE vote_v3 = '{vote}') AS {vote}"


ANSWERS = ("click", "error", "purchase", "signup")  # "view" is left to the other column


@query(f"""{WIDE} SELECT CASE WHEN grouping(vote_v2) = 1 THEN 'All' ELSE vote_v2 END AS vote_v2,
  {', '.join(map(_column, ANSWERS))},
  count(*) FILTER (WHERE vote_v3 NOT IN {ANSWERS}) AS "(other)", count(*) AS "All"
FROM cells WHERE vote_v2 IS NOT NULL AND vote_v3 IS NOT NULL GROUP BY CUBE (vote_v2)""")
def transition_table(spark, folder):
    return compare.transition_table(_wide(spark, folder), "vote_v2", "vote_v3", ANSWERS)


@query(f"""WITH {LOG}, r AS (
  SELECT *, row_number() OVER (PARTITION BY persona, model, version
                               ORDER BY ts DESC, event_id DESC) AS rn FROM log
  WHERE (model = 'm/a' AND version IN ('v2', 'v3')) OR (model = 'm/b' AND version = 'v10'))
SELECT model, version, vote, count(*) AS count FROM r WHERE rn = 1 GROUP BY 1, 2, 3""")
def cell_distributions(spark, folder):
    return compare.cell_distributions(
        log(spark, folder), list(CELLS.values()), log_order(), **NAMES)


@query("""SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def enrich_left(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return joins.enrich(docs, table(spark, folder, "labels"), "doc_id")


@query("""SELECT count(*) AS n_rows, count(*) FILTER (WHERE l.quality IS NULL) AS n_missing
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def coverage(spark, folder):
    return joins.coverage(
        table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id", "quality")


@query("""SELECT e.event_id, e.user_id, o.o_orderkey FROM events e
LEFT JOIN orders o ON e.user_id = o.o_custkey""")
def enrich_fan_out(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id")
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("user_id"), "o_orderkey")
    return joins.enrich(events, orders, "user_id")


@query("""SELECT count(*) AS n_rows, count(*) FILTER (WHERE o.o_orderkey IS NULL) AS n_missing
FROM events e LEFT JOIN orders o ON e.user_id = o.o_custkey""")
def coverage_fan_out(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "user_id")
    return joins.coverage(table(spark, folder, "events"), orders, "user_id", "o_orderkey")


@query("""SELECT c_custkey, c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                  AND o.o_orderstatus = 'F')""")
def todo_anti(spark, folder):
    done = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("c_custkey"))
    return joins.not_done(
        table(spark, folder, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@query("""SELECT c_custkey FROM customer EXCEPT
SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def todo_difference(spark, folder):
    done = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("c_custkey"))
    return sets.difference(table(spark, folder, "customer"), done, "c_custkey")


@query("""SELECT c_custkey, c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""")
def cohort_semi(spark, folder):
    members = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("c_custkey"))
    return joins.cohort(
        table(spark, folder, "customer").select("c_custkey", "c_name"), members, ["c_custkey"])
