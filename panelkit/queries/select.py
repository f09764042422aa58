"""Feeds, filters, options, samples, chunks, versions and appends."""

from pyspark.sql import functions as F

from panelkit import fixed_values as fv
from panelkit.functions import columns
from panelkit.functions.columns import bucket, lookup
from panelkit.operators import joins, sampling, sets
from panelkit.operators.filters import (
    version_pair_error, where_any_of, where_equal, where_selected)
from panelkit.operators.numbering import chunk_rows
from panelkit.queries.base import LOG, log, query, table


@query(f"""WITH {LOG} SELECT event_id, ts, persona, vote, elapsed_sec, props, model, version
FROM log WHERE vote IN ('purchase', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 50""")
def recent_feed(spark, folder):
    view = where_any_of(log(spark, folder), {"vote": ["purchase", "signup"], "model": []})
    return sampling.recent(view, ["ts", "event_id"], 50)


@query(f"""WITH {LOG} SELECT event_id, ts, persona, vote, elapsed_sec, props, model, version
FROM log ORDER BY ts, event_id LIMIT 3""")
def head_preview(spark, folder):
    return sampling.head(log(spark, folder), ["ts", "event_id"], 3)


@query(f"""WITH {LOG}, late AS (SELECT event_id, CASE WHEN event_id % 997 > 0 THEN NULL
  ELSE ts END AS seen FROM log)
SELECT event_id, seen FROM late ORDER BY seen NULLS LAST, event_id LIMIT 3000""")
def head_with_nulls(spark, folder):
    # Fewer rows have a time than are wanted; the rest come last.
    late = log(spark, folder).select(
        "event_id", F.when(F.col("event_id") % 997 == 0, F.col("ts")).alias("seen"))
    return sampling.head(late, ["seen", "event_id"], 3000)


@query(f"""WITH {LOG}, late AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN NULL
  ELSE ts END AS seen FROM log)
SELECT event_id, seen FROM late ORDER BY seen DESC NULLS LAST, event_id DESC NULLS LAST LIMIT 40""")
def recent_with_nulls(spark, folder):
    late = log(spark, folder).select(
        "event_id", F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("seen"))
    return sampling.recent(late, ["seen", "event_id"], 40)


@query(f"""WITH {LOG} SELECT event_id, persona, vote FROM log WHERE model = 'm/a' AND version = 'v3'""")
def filter_equal(spark, folder):
    return where_equal(log(spark, folder), model="m/a", version="v3").select(
        "event_id", "persona", "vote")


@query(f"""WITH {LOG} SELECT event_id, model, version, vote FROM log
WHERE version IS NOT NULL AND vote IN ('view', 'error')""")
def filter_selected(spark, folder):
    view = where_selected(log(spark, folder), {"version": None, "vote": ["view", "error"]})
    return view.select("event_id", "model", "version", "vote")


@query("""SELECT DISTINCT * FROM (
  SELECT 'c_mktsegment' AS "column", c_mktsegment AS value FROM customer
  UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer)
WHERE value IS NOT NULL""")
def filter_options(spark, folder):
    return sets.filter_options(table(spark, folder, "customer"), ["c_mktsegment", "c_nationkey"])


@query("""WITH e AS (SELECT event_id, 'v' || (json_extract_string(props, '$.k')::INT % 3) AS a,
  CASE WHEN event_type <> 'error' THEN 'v' || (event_id % 3) END AS b FROM events)
SELECT event_id, CASE WHEN a IS DISTINCT FROM b
  THEN 'version pair differs: ' || a || ' / ' || coalesce(b, '?') END AS error FROM e""")
def version_pair_check(spark, folder):
    k = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(3)).cast("string")
    other = F.pmod("event_id", F.lit(3)).cast("string")
    voter = F.concat(F.lit("v"), k)
    system = F.when(F.col("event_type") != "error", F.concat(F.lit("v"), other))
    return table(spark, folder, "events").select(
        "event_id", version_pair_error(voter, system).alias("error"))


@query("""SELECT DISTINCT 'v' || n AS version, n AS version_number FROM (
  SELECT p_type, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 20260428142500 + p_size END AS n
  FROM part) a
WHERE p_type = 'PROMO' AND n IN (
  SELECT CASE WHEN p_size % 2 = 0 THEN p_size ELSE 20260428142500 + p_size END FROM part
  WHERE p_type = 'ECONOMY')""")
def asset_versions(spark, folder):
    # Short and dated versions.
    size = F.col("p_size").cast("bigint")
    number = F.when(size % 2 == 0, size).otherwise(size + 20260428142500)
    assets = table(spark, folder, "part").select(
        F.col("p_type").alias("kind"), F.concat(F.lit("v"), number.cast("string")).alias("version"))
    return sets.paired_versions(assets, ("PROMO", "ECONOMY")).withColumn(
        "version_number", F.col("version_number").cast("bigint"))


CHUNKED = """c AS (SELECT c_custkey, c_name,
  CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 10 + 1 AS INTEGER) AS chunk_id,
  CAST((row_number() OVER (ORDER BY c_custkey) - 1) % 10 AS INTEGER) AS idx FROM customer)"""


def _chunked(spark, folder):
    return chunk_rows(table(spark, folder, "customer").select("c_custkey", "c_name"), ["c_custkey"])


@query(f"WITH {CHUNKED} SELECT c_custkey, c_name, chunk_id, idx FROM c")
def chunk_assign(spark, folder):
    return _chunked(spark, folder)


@query(f"""WITH {CHUNKED} SELECT c.c_custkey, c.chunk_id, c.idx, d.text FROM c
JOIN documents d ON d.doc_id // 10 + 1 = c.chunk_id AND d.doc_id % 10 = c.idx""")
def note_attach(spark, folder):
    notes = table(spark, folder, "documents").select(
        (F.floor(F.col("doc_id") / 10) + 1).cast("int").alias("chunk_id"),
        F.pmod("doc_id", F.lit(10)).cast("int").alias("idx"), "text")
    return joins.attach_notes(_chunked(spark, folder).drop("c_name"), notes).select(
        "c_custkey", "chunk_id", "idx", "text")


@query("""SELECT c_custkey, c_name FROM customer
ORDER BY md5('7|' || c_custkey), c_custkey LIMIT 100""")
def sample_md5(spark, folder):
    people = table(spark, folder, "customer").select("c_custkey", "c_name")
    return sampling.sample_n(people, "c_custkey", 100, 7)


@query("""SELECT c_custkey, c_name FROM customer
ORDER BY md5('7|' || c_custkey), c_custkey LIMIT 101""")
def sample_md5_101(spark, folder):
    people = table(spark, folder, "customer").select("c_custkey", "c_name")
    return sampling.sample_n(people, "c_custkey", 101, 7)


@query("""SELECT doc_id, CASE WHEN doc_id % 400 < 300 THEN 'colour ' || (doc_id % 400)
  ELSE '#666' END AS color FROM documents""")
def lookup_many(spark, folder):
    key = F.concat(F.lit("k"), F.pmod("doc_id", F.lit(400)).cast("string"))
    listed = {f"k{i}": f"colour {i}" for i in range(300)}
    return table(spark, folder, "documents").select(
        "doc_id", lookup(key, listed).alias("color"))


@query("""SELECT c_custkey, CASE WHEN n_nationkey < 20 THEN n_name ELSE 'elsewhere' END AS home
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def lookup_joined(spark, folder):
    homes = table(spark, folder, "nation").where("n_nationkey < 20").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("home"))
    people = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return joins.lookup_join(people, homes, "c_nationkey", "home", "elsewhere").drop("c_nationkey")


@query("""SELECT p_partkey, p_size FROM part WHERE p_size > 29 AND p_size <= 49""")
def band_filter(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_size")
    return where_any_of(parts.withColumn("age_bucket", bucket("p_size")), {
        "age_bucket": list(fv.AGE_LABELS[1:3])}).drop("age_bucket")


@query("""SELECT DISTINCT split_part(p_type, ' ', 1) || '/' || p_brand AS model FROM part""")
def model_key(spark, folder):
    provider = F.substring_index("p_type", " ", 1)
    return table(spark, folder, "part").select(
        columns.model_key(provider, "p_brand").alias("model")).distinct()


@query("""SELECT o_orderkey, o_orderpriority FROM (
  SELECT o_orderkey, o_orderpriority, row_number() OVER (
    PARTITION BY o_orderpriority ORDER BY md5('7|' || o_orderkey), o_orderkey) AS rn FROM orders)
WHERE rn <= 500""")
def sample_stratified(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.sample_per_stratum(orders, "o_orderpriority", "o_orderkey", 500, 7)


@query("""WITH r AS (SELECT c_custkey, c_nationkey,
    row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS row FROM customer),
s AS (SELECT c_nationkey, min(row) AS start, count(*) AS size,
    row_number() OVER (ORDER BY c_nationkey) - 1 AS shard FROM r GROUP BY 1),
d AS (SELECT range AS draw,
    CAST('0x' || left(md5('7|shard|' || range), 12) AS BIGINT) AS a,
    CAST('0x' || left(md5('7|row|' || range), 12) AS BIGINT) AS b FROM range(500))
SELECT d.draw, r.c_custkey, r.c_nationkey FROM d
JOIN s ON s.shard = d.a % (SELECT count(*) FROM s)
JOIN r ON r.row = s.start + d.b % s.size""")
def sample_with_repeats(spark, folder):
    people = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return sampling.draw_with_repeats(people, "c_nationkey", "c_custkey", 500, 7)


GRID = [("m/a", "v2", 100), ("m/a", "v3", 50), ("m/b", "v3", 25)]


@query(" UNION ALL ".join(
    f"""(SELECT c_custkey, '{m}' AS model, '{v}' AS version FROM customer
ORDER BY md5('7|{m}|{v}|' || c_custkey), c_custkey LIMIT {n})""" for m, v, n in GRID))
def run_grid(spark, folder):
    people = table(spark, folder, "customer").select("c_custkey")
    return sampling.run_grid(people, "c_custkey", GRID, 7)


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'
UNION ALL BY NAME SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P'""")
def append_union(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = orders.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    return sets.append(orders.where("o_orderstatus <> 'P'"), new)
