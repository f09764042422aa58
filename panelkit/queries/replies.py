"""Replies to typed columns and dead letters, and the batch call."""

from pyspark.sql import functions as F

from panelkit.functions.parse import first_alias, parse_replies, read_object, split_replies, strip_noise
from panelkit.operators.infer import call_model, smoke_call
from panelkit.operators.metrics import run_summary
from panelkit.queries.base import REPLY_OBJECT, SPACE, STRIPPED, query, reply_object, table


def _wrapped(spark, folder):
    """Whole documents as replies inside a thinking block and a code fence."""
    return table(spark, folder, "documents").select("doc_id", F.concat(
        F.lit('<think>\n{"vote": "draft"}\n</think>\n```json\n'), reply_object("lang", "text"),
        F.lit("\n```")).alias("raw_response"))


@query(rf"""WITH r AS (SELECT doc_id, '<think>' || chr(10) || '{{"vote": "draft"}}' || chr(10) ||
    '</think>' || chr(10) || '```json' || chr(10) || {REPLY_OBJECT} || chr(10) || '```'
    AS raw_response FROM documents),
o AS (SELECT doc_id, regexp_extract({STRIPPED}, '(?s)\{{.*\}}') AS object FROM r)
SELECT doc_id, json_extract_string(object, '$.vote') AS vote,
       json_extract_string(object, '$.reason') AS reason, false AS salvaged,
       CAST(NULL AS VARCHAR) AS error FROM o""")
def strip_and_extract(spark, folder):
    return parse_replies(_wrapped(spark, folder)).drop("raw_response")


def cut_replies(spark, folder):
    """Documents as whole, shortened, halved, half-filled and empty replies."""
    whole, kind = F.col("whole"), F.pmod("n_chars", F.lit(5))
    raw = (
        F.when(kind == 0, whole)
        .when(kind == 1, F.substring(whole, F.lit(1), (F.length(whole) - F.pmod(
            "n_chars", F.lit(47))).cast("int")))
        .when(kind == 2, F.substring(whole, F.lit(1), F.floor(F.length(whole) / 2).cast("int")))
        .when(kind == 3, F.concat(F.lit('{"vote":"'), "lang", F.lit('", ')))
        .otherwise(F.lit(""))
    )
    return (
        table(spark, folder, "documents")
        .select("doc_id", "lang", "n_chars", reply_object("lang", "text").alias("whole"))
        .select("doc_id", "lang", raw.alias("raw_response"))
    )


CUT = rf"""WITH w AS (SELECT doc_id, lang, n_chars, {REPLY_OBJECT} AS whole FROM documents),
r AS (SELECT doc_id, lang, CASE n_chars % 5 WHEN 0 THEN whole
    WHEN 1 THEN left(whole, length(whole) - n_chars % 47)
    WHEN 2 THEN left(whole, length(whole) // 2)
    WHEN 3 THEN '{{"vote":"' || lang || '", ' ELSE '' END AS raw_response FROM w),
s AS (SELECT doc_id, lang, raw_response, {STRIPPED} AS t FROM r),
p AS (SELECT *, regexp_extract(t, '(?s)\{{.*\}}') AS outer_text,
    regexp_extract(t, '(?s)^.*(\{{.*)$', 1) AS tail FROM s),
q AS (SELECT *, regexp_replace(regexp_replace(tail, '{SPACE}+$', ''), ',+$', '') AS cut FROM p),
f AS (SELECT *, CASE WHEN tail = '' THEN t
    WHEN contains(tail, '}}') THEN regexp_extract(tail, '(?s)^.*\}}')
    ELSE cut || CASE WHEN (length(cut) - length(replace(cut, '"', ''))) % 2 = 1
                     THEN '"' ELSE '' END || '}}' END AS closed FROM q),
m AS (SELECT *, coalesce(json_valid(nullif(outer_text, '')), false) AS strict,
    coalesce(json_valid(nullif(closed, '')), false) AS repaired FROM f),
j AS (SELECT *, CASE WHEN strict THEN outer_text WHEN repaired THEN closed END AS object FROM m),
v AS (SELECT *, nullif(json_extract_string(object, '$.vote'), '') AS vote,
    nullif(json_extract_string(object, '$.reason'), '') AS reason FROM j),
parsed AS (SELECT doc_id, lang, raw_response, vote, reason, NOT strict AND repaired AS salvaged,
    CASE WHEN object IS NULL THEN 'no parseable JSON in response: ' || left(raw_response, 200)
         WHEN vote IS NULL OR reason IS NULL THEN 'missing keys: [' ||
           CASE WHEN len(json_keys(object)) > 0
                THEN '''' || array_to_string(json_keys(object), ''', ''') || '''' ELSE '' END || ']'
    END AS error FROM v)"""


@query(f"{CUT} SELECT doc_id, vote, reason, salvaged, error FROM parsed")
def repair_truncated(spark, folder):
    return parse_replies(cut_replies(spark, folder)).drop("lang", "raw_response")


@query(f"""{CUT} SELECT doc_id, lang, error, raw_response FROM parsed WHERE error IS NOT NULL""")
def dead_letter_split(spark, folder):
    return split_replies(parse_replies(cut_replies(spark, folder)))[1]


@query(f"""{CUT} SELECT lang, count(*) AS attempts,
  count(*) FILTER (WHERE error IS NULL) AS successes,
  count(*) FILTER (WHERE error IS NULL) / CAST(count(*) AS DOUBLE) AS rate
FROM parsed GROUP BY 1""")
def run_success(spark, folder):
    return run_summary(parse_replies(cut_replies(spark, folder)), ["lang"], latency=None)


@query("""WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events)
SELECT event_id, CASE CAST(k AS INTEGER) % 8
    WHEN 0 THEN k WHEN 1 THEN '0' WHEN 2 THEN event_type WHEN 3 THEN 'true'
    WHEN 4 THEN event_type WHEN 5 THEN event_type WHEN 6 THEN NULL ELSE event_type END AS vote
FROM e""")
def first_alias_value(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", F.concat(F.lit('"'), "event_type", F.lit('"')).alias("quoted"),
        F.get_json_object("props", "$.k").alias("k"))
    kind = F.pmod(F.col("k").cast("int"), F.lit(8))

    def shape(template: str):
        return F.replace(F.replace(F.lit(template), F.lit("$k"), "k"), F.lit("$e"), "quoted")

    text = (
        F.when(kind == 0, shape('{"party": $e, "vote": "$k"}'))
        .when(kind == 1, shape('{"vote": 0, "party": "0", "정당": $e}'))
        .when(kind == 2, shape('{"vote": "", "party": null, "정당": $e}'))
        .when(kind == 3, shape('{"vote": false, "party": [], "지지": true}'))
        .when(kind == 4, shape('{"vote": "first", "vote": $e}'))
        .when(kind == 5, shape('{"vote": {}, "투표": $e, "선택": "late"}'))
        .when(kind == 6, shape('{"vote": 0.0, "choice": $e}'))
        .otherwise(shape('{"지지정당": $e}'))
    )
    keys = ("vote", "party", "정당", "지지정당", "투표", "선택", "지지")
    return events.select("event_id", text.alias("text")).select(
        "event_id", first_alias(read_object("text", keys), keys).alias("vote"))


@query(f"""SELECT conv_id, turn, {STRIPPED.replace('raw_response', "'<think>x</think>```json ' || text || '```'")} AS text
FROM conversations""")
def noise_stripped(spark, folder):
    raw = F.concat(F.lit("<think>x</think>```json "), "text", F.lit("```"))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", strip_noise(raw).alias("text"))


def length_rule():
    """A fixed rule in the place of a model: it answers by the length of the message.

    Nested, so that it travels to the workers by value and they need no import.
    """
    def factory(model: str, version: str):
        def answer(system: str, user: str) -> str:
            if len(user) > 8000:
                raise ValueError("message too long")
            size = "long" if len(user) >= 1000 else "short"
            return f'{{"vote": "{model} {size}", "reason": "{system}: {len(user)}",'

        return answer

    return factory


@query("""SELECT doc_id,
  CASE WHEN length(text) <= 8000 THEN lang || CASE WHEN length(text) >= 1000 THEN ' long'
       ELSE ' short' END END AS vote,
  CASE WHEN length(text) <= 8000 THEN source || ': ' || length(text) END AS reason,
  CASE WHEN length(text) > 8000 THEN 'ValueError: message too long' END AS error
FROM documents""")
def batch_infer(spark, folder):
    prompts = table(spark, folder, "documents").select(
        "doc_id", F.col("lang").alias("model"), F.col("source").alias("version"),
        F.col("source").alias("system_text"), F.col("text").alias("user_text"))
    return parse_replies(call_model(prompts, length_rule())).select(
        "doc_id", "vote", "reason", "error")


def counting_rule():
    """A fixed rule whose replies tell which client of its setting in the task gave them."""
    made: dict = {}

    def factory(model: str, version: str):
        number = made[model, version] = made.get((model, version), 0) + 1

        def answer(system: str, user: str) -> str:
            return f'{{"vote": "{model}", "reason": "client {number}"}}'

        return answer

    return factory


@query("""SELECT lang AS vote, 'client 1' AS reason, count(*) AS n FROM documents GROUP BY 1""")
def client_cache(spark, folder):
    # In each task every setting has one client, which gives all the task's replies.
    prompts = table(spark, folder, "documents").repartition(8).select(
        "doc_id", F.col("lang").alias("model"), F.lit("v").alias("version"),
        F.col("source").alias("system_text"), F.col("lang").alias("user_text"))
    replies = parse_replies(call_model(prompts, counting_rule()))
    return replies.groupBy("vote", "reason").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE false) AS n_errors
FROM (SELECT 1 FROM documents LIMIT 1)""")
def smoke_reply(spark, folder):
    prompts = table(spark, folder, "documents").select(
        "doc_id", F.col("lang").alias("model"), F.lit("v").alias("version"),
        F.col("source").alias("system_text"), F.col("lang").alias("user_text"))
    return smoke_call(prompts, length_rule()).agg(
        F.count("*").alias("n"), F.count("error").alias("n_errors"))
