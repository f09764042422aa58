"""Whole runs over the customers as a panel, and the pages over a log of events."""

from pyspark.sql import functions as F

from panelkit import schemas
from panelkit.functions import columns
from panelkit.plans import panels, runs
from panelkit.queries.base import CELLS, LOG, log, query, table
from panelkit.runtime import new_folder
from panelkit.sources import readers


def _panel(spark, folder):
    people = table(spark, folder, "customer").select(
        F.md5(F.col("c_custkey").cast("string")).alias("uuid"),
        (F.col("c_nationkey") + 20).alias("age"), F.col("c_mktsegment").alias("occupation"),
        F.col("c_name").alias("persona"))
    return readers.with_missing(people, schemas.PERSONA)


def _assets(spark, folder):
    """Each region as a prompt version: a template and the context that goes into it."""
    region = table(spark, folder, "region")
    version = F.concat(F.lit("v"), F.col("r_regionkey").cast("string"))
    template = region.select(
        F.lit("system_prompt").alias("kind"), version.alias("version"),
        F.lit("{{of}} {political_context}").alias("text"))
    context = region.select(
        F.lit("voter_context").alias("kind"), version.alias("version"), F.col("r_name").alias("text"))
    return template.unionByName(context)


def parity_rule():
    """A fixed rule in the place of a model: it answers by the customer's number."""
    def factory(model: str, version: str):
        def answer(system: str, user: str) -> str:
            number = int(user.split("Customer#")[1][:9])
            if number % 10 == 7:
                raise ValueError("no reply")
            note = " with note" if "[정치적 이해관계]" in user else ""
            vote = ("A", "B", "C")[(number + len(version) + len(model)) % 3]
            return f'```json\n{{"vote": "{vote}", "reason": "{system}{note}"}}\n```'

        return answer

    return factory


def _answered(spark, out):
    return runs.logged(spark, out).select(
        "persona_uuid", "age", "occupation", "persona_summary", "vote", "reason", "model",
        "voter_context_version")


def _sampled(model: str, version: str, n: int) -> str:
    return f"""(SELECT c_custkey, c_name, c_nationkey, c_mktsegment, '{model}' AS model,
  '{version}' AS version FROM customer
  ORDER BY md5('3|{model}|{version}|' || md5(CAST(c_custkey AS VARCHAR))) LIMIT {n})"""


ANSWERED = """SELECT md5(CAST(c_custkey AS VARCHAR)) AS persona_uuid,
  CAST(c_nationkey + 20 AS INTEGER) AS age, c_mktsegment AS occupation, c_name AS persona_summary,
  substr('ABC', CAST((c_custkey + length(version) + length(model)) % 3 + 1 AS INTEGER), 1) AS vote,
  '{of} ' || r_name || note AS reason, model, version AS voter_context_version
FROM asked JOIN region ON version = 'v' || r_regionkey WHERE c_custkey % 10 <> 7"""


@query(f"""WITH asked AS (SELECT *, '' AS note FROM (
  {_sampled('p/m', 'v1', 150)} UNION ALL {_sampled('q/longer', 'v3', 80)})) {ANSWERED}""")
def sample_run(spark, folder):
    # Started twice under one name, the second time with a cell more.
    out, panel, assets = new_folder(spark, "run"), _panel(spark, folder), _assets(spark, folder)
    cells = [("p/m", "v1", 150), ("q/longer", "v3", 80)]
    for n in (1, 2):
        runs.sample_run(panel, assets, cells[:n], parity_rule(), out, "first", seed=3, tasks=8)
    return _answered(spark, out)


@query(f"""WITH base AS {_sampled('p/m', 'v1', 150)},
first AS (SELECT *, '' AS note FROM base),
again AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, 'q/longer' AS model, 'v4' AS version,
  CASE WHEN c_custkey % 2 = 0 THEN ' with note' ELSE '' END AS note
  FROM base WHERE c_custkey % 10 <> 7),
asked AS (SELECT * FROM first UNION ALL SELECT * FROM again) {ANSWERED}""")
def cohort_run(spark, folder):
    out, assets = new_folder(spark, "run"), _assets(spark, folder)
    runs.sample_run(_panel(spark, folder), assets, [("p/m", "v1", 150)], parity_rule(), out,
                    "first", seed=3, tasks=8)
    key = F.md5(F.col("c_custkey").cast("string"))
    notes = table(spark, folder, "customer").where("c_custkey % 2 = 0").select(
        key.alias("persona_uuid"), F.col("c_name").alias("political_interest"))
    runs.cohort_run(spark, assets, ("p/m", "v1"), ("q/longer", "v4"), parity_rule(), out, "again",
                    notes, tasks=8)
    return _answered(spark, out)


def _response_log(spark, folder):
    """The events as full log rows, with the customer of each as its profile."""
    people = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("persona"), (F.col("c_nationkey") * 4).alias("age"),
        F.col("c_mktsegment").alias("province"))
    at = F.date_format("ts", "yyyyMMdd-HHmmss")
    rows = log(spark, folder).join(people, "persona", "left").withColumns({
        "persona_uuid": F.col("persona").cast("string"),
        "voter_context_version": F.col("version"), "system_prompt_version": F.col("version"),
        "response_file": columns.response_name(
            at, "model", F.lpad(F.col("event_id").cast("string"), 8, "0"), "version")})
    return readers.with_missing(rows, schemas.RESPONSE_LOG)


PAGE_LOG = f"""{LOG}, page AS (SELECT CAST(persona AS VARCHAR) AS persona_uuid,
  CAST(c_nationkey * 4 AS INTEGER) AS age, c_mktsegment AS province, vote, elapsed_sec, model,
  version, event_id, strftime(ts, '%Y%m%d-%H%M%S') || '_' || replace(model, '/', '_') || '_' ||
    lpad(CAST(event_id AS VARCHAR), 8, '0')
    || coalesce('_' || version || '_' || version, '') || '.json' AS response_file
  FROM log LEFT JOIN customer ON persona = c_custkey)"""


@query(f"""WITH {PAGE_LOG}, b AS (SELECT vote, CASE WHEN age > 0 AND age <= 29 THEN '20대'
    WHEN age > 29 AND age <= 39 THEN '30대' WHEN age > 39 AND age <= 49 THEN '40대'
    WHEN age > 49 AND age <= 59 THEN '50대' WHEN age > 59 AND age <= 69 THEN '60대'
    WHEN age > 69 AND age <= 200 THEN '70+' END AS age_bucket FROM page WHERE version IS NOT NULL),
c AS (SELECT age_bucket, vote, count(*) AS n FROM b WHERE age_bucket IS NOT NULL GROUP BY 1, 2),
l(age_bucket) AS (VALUES ('20대'), ('30대'), ('40대'), ('50대'), ('60대'), ('70+'))
SELECT l.age_bucket, v.vote, coalesce(c.n, 0) AS count
FROM l JOIN (SELECT DISTINCT vote FROM c) v ON true
LEFT JOIN c ON c.age_bucket = l.age_bucket AND c.vote = v.vote""")
def dashboard_by_age(spark, folder):
    return panels.dashboard(_response_log(spark, folder))["by_age"]


@query(f"""WITH {PAGE_LOG} SELECT persona_uuid, model, vote, province, response_file,
  '#666' AS color, printf('%.1f', elapsed_sec) AS latency
FROM page WHERE province IN ('BUILDING', 'MACHINERY') ORDER BY response_file DESC LIMIT 20""")
def dashboard_feed(spark, folder):
    facets = {"province": ["BUILDING", "MACHINERY"], "sex": []}
    feed = panels.dashboard(_response_log(spark, folder), facets=facets, n_recent=20)["feed"]
    return feed.select("persona_uuid", "model", "vote", "province", "response_file", "color",
                       "latency")


@query(f"""WITH {PAGE_LOG}, r AS (SELECT *, row_number() OVER (
    PARTITION BY persona_uuid, model, version ORDER BY response_file DESC) AS rn FROM page),
k AS (SELECT * FROM r WHERE rn = 1),
notes AS (SELECT CAST(doc_id AS VARCHAR) AS persona_uuid, source AS political_interest
          FROM documents)
SELECT a.persona_uuid, a.age, a.province, a.vote AS vote_v2, b.vote AS vote_v3, c.vote AS vote_v10_b,
  political_interest
FROM k a LEFT JOIN k b ON b.persona_uuid = a.persona_uuid AND b.model = 'm/a' AND b.version = 'v3'
LEFT JOIN k c ON c.persona_uuid = a.persona_uuid AND c.model = 'm/b' AND c.version = 'v10'
LEFT JOIN notes ON notes.persona_uuid = a.persona_uuid
WHERE a.model = 'm/a' AND a.version = 'v2'""")
def comparison_wide(spark, folder):
    notes = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("persona_uuid"),
        F.col("source").alias("political_interest"))
    pages = panels.comparison(_response_log(spark, folder), CELLS, notes, ("v2", "v3"))
    return pages["wide"].select("persona_uuid", "age", "province", "vote_v2", "vote_v3",
                                "vote_v10_b", "political_interest")


@query(f"""WITH {PAGE_LOG}, f AS (SELECT * FROM page WHERE province IN ('BUILDING', 'MACHINERY'))
SELECT (SELECT count(*) FROM f) AS n_filtered, (SELECT count(*) FROM page) AS n_rows""")
def dashboard_counts(spark, folder):
    facets = {"province": ["BUILDING", "MACHINERY"], "sex": []}
    return panels.dashboard(_response_log(spark, folder), facets=facets)["counts"]


@query(f"""WITH {PAGE_LOG} SELECT model, vote, count(*) AS count,
  count(*) / CAST(sum(count(*)) OVER (PARTITION BY model) AS DOUBLE) * 100 AS pct
FROM page WHERE vote IS NOT NULL GROUP BY 1, 2""")
def dashboard_share(spark, folder):
    return panels.dashboard(_response_log(spark, folder))["share_by_model"]


@query(f"""WITH {PAGE_LOG} SELECT count(*) AS n_rows, count(DISTINCT model) AS n_models,
  round(avg(elapsed_sec), 9) AS mean_latency, count(DISTINCT persona_uuid) AS n_personas
FROM page""")
def dashboard_kpi(spark, folder):
    return panels.dashboard(_response_log(spark, folder))["kpi"].withColumn(
        "mean_latency", F.round("mean_latency", 9))


@query(f"""WITH {PAGE_LOG}, o AS (
  SELECT 'model' AS "column", model AS value FROM page
  UNION ALL SELECT 'province', province FROM page
  UNION ALL SELECT 'voter_context_version', version FROM page
  UNION ALL SELECT 'system_prompt_version', version FROM page)
SELECT DISTINCT "column", value FROM o WHERE value IS NOT NULL""")
def dashboard_options(spark, folder):
    return panels.dashboard(_response_log(spark, folder))["options"]


COMPARED = f"""WITH {PAGE_LOG}, r AS (SELECT *, row_number() OVER (
    PARTITION BY persona_uuid, model, version ORDER BY response_file DESC) AS rn FROM page),
k AS (SELECT * FROM r WHERE rn = 1),
w AS (SELECT a.persona_uuid, a.province, a.vote AS vote_v2, b.vote AS vote_v3, c.vote AS vote_v10_b
FROM k a LEFT JOIN k b ON b.persona_uuid = a.persona_uuid AND b.model = 'm/a' AND b.version = 'v3'
LEFT JOIN k c ON c.persona_uuid = a.persona_uuid AND c.model = 'm/b' AND c.version = 'v10'
WHERE a.model = 'm/a' AND a.version = 'v2')"""


def _comparison(spark, folder, **view):
    notes = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("persona_uuid"),
        F.col("source").alias("political_interest"))
    return panels.comparison(_response_log(spark, folder), CELLS, notes, ("v2", "v3"), **view)


def _distribution(cell: str, rows: str) -> str:
    return f"""SELECT '{cell}' AS cell, {cell} AS vote, count(*) AS count,
  count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100 AS pct,
  count(*) / CAST(max(count(*)) OVER () AS DOUBLE) * 100 AS bar_pct
FROM {rows} WHERE {cell} IS NOT NULL GROUP BY {cell}"""


@query(f"""{COMPARED}, b AS (SELECT * FROM w WHERE vote_v2 IS NOT NULL AND vote_v3 IS NOT NULL)
{_distribution('vote_v2', 'b')} UNION ALL {_distribution('vote_v3', 'b')}
UNION ALL {_distribution('vote_v10_b', 'w')}""")
def comparison_distribution(spark, folder):
    pages = _comparison(spark, folder)
    parts = [pages[f"distribution_{cell}"].withColumnRenamed(f"vote_{cell}", "vote").withColumn(
        "cell", F.lit(f"vote_{cell}")) for cell in CELLS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""{COMPARED} SELECT count(*) AS n_pairs,
  count(*) FILTER (WHERE vote_v2 <> vote_v3) AS n_changed,
  count(*) FILTER (WHERE vote_v2 <> vote_v3) / CAST(count(*) AS DOUBLE) * 100 AS pct_changed
FROM w WHERE vote_v2 IS NOT NULL AND vote_v3 IS NOT NULL""")
def comparison_change(spark, folder):
    return _comparison(spark, folder)["change"]


@query(f"""{COMPARED} SELECT persona_uuid, province, vote_v2, vote_v3 FROM w
WHERE vote_v2 <> vote_v3 AND province IN ('BUILDING', 'MACHINERY')
  AND vote_v2 IN ('click', 'purchase', 'view')""")
def comparison_view(spark, folder):
    choices = {"province": ["BUILDING", "MACHINERY"], "vote_v2": ["click", "purchase", "view"]}
    return _comparison(spark, folder, show="changed", choices=choices)["view"].select(
        "persona_uuid", "province", "vote_v2", "vote_v3")


@query(f"""{COMPARED} SELECT count(*) FILTER (WHERE vote_v2 = vote_v3) AS n_shown,
  count(*) AS n_personas FROM w""")
def comparison_counts(spark, folder):
    return _comparison(spark, folder, show="kept")["view_counts"]
