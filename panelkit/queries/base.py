"""Registry of the queries over the given tables, each with its SQL twin."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function name."""
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- events read as a response log ---------------------------------------------------
# user = persona, event type = answer, value = latency, (ts, event_id) = order.
# The reply's number k stands in for the model, the third of the month for the version;
# the last days carry no version.

def log(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.dayofmonth("ts")
    return table(spark, folder, "events").select(
        "event_id", "ts", F.col("user_id").alias("persona"), F.col("event_type").alias("vote"),
        F.col("value").alias("elapsed_sec"), "props",
        F.when(k < 50, "m/a").otherwise("m/b").alias("model"),
        F.when(day <= 10, "v2").when(day <= 20, "v3").when(day <= 29, "v10").alias("version"),
    )


def log_order() -> Column:
    return F.struct("ts", "event_id")


LOG = """log AS (
  SELECT event_id, ts, user_id AS persona, event_type AS vote, value AS elapsed_sec, props,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50
              THEN 'm/a' ELSE 'm/b' END AS model,
         CASE WHEN day(ts) <= 10 THEN 'v2' WHEN day(ts) <= 20 THEN 'v3'
              WHEN day(ts) <= 29 THEN 'v10' END AS version
  FROM events)"""

CELLS = {"v2": ("m/a", "v2"), "v3": ("m/a", "v3"), "v10_b": ("m/b", "v10")}

# --- documents read as model replies ---------------------------------------------------
# lang = answer, text = reason; the object is written by hand so both engines see the
# same characters.

def reply_object(vote: str, reason: str) -> Column:
    text = F.col(reason)
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"),
                           ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('{"vote":"'), F.col(vote), F.lit('","reason":"'), text, F.lit('"}'))


REPLY_OBJECT = r"""'{"vote":"' || lang || '","reason":"' ||
    replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'),
            chr(13), '\r'), chr(9), '\t') || '"}'"""

# White space, as a class RE2 reads.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
STRIPPED = (
    r"regexp_replace(regexp_replace(raw_response, '(?s)<think>.*?</think>', '', 'g'), "
    rf"'```(?:json)?{SPACE}*', '', 'g')"
)
