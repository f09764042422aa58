"""Readers and writers: what was written reads back whole.

Each query writes under the shared checkpoint folder and reads its own files.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit import schemas
from panelkit.functions import columns
from panelkit.functions.parse import parse_replies, split_replies
from panelkit.operators import sets
from panelkit.operators.numbering import chunk_rows
from panelkit.queries.base import LOG, log, query, table
from panelkit.queries.replies import CUT, cut_replies
from panelkit.runtime import new_folder
from panelkit.sources import readers, sinks


def _turns(spark, folder):
    """Conversation turns as log rows; the texts hold quotes, commas and line breaks."""
    rows = table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("persona_uuid"), F.col("role").alias("vote"),
        F.col("text").alias("reason"), (F.col("turn") / 8).alias("elapsed_sec"),
        F.when(F.col("role") != "user", F.col("role")).alias("model"))
    return readers.with_missing(rows, schemas.RESPONSE_LOG)


TURN_COLUMNS = ("persona_uuid", "vote", "reason", "elapsed_sec", "model", "occupation")
TURNS = """SELECT conv_id || '-' || turn AS persona_uuid, role AS vote, text AS reason,
  turn / CAST(8 AS DOUBLE) AS elapsed_sec, CASE WHEN role <> 'user' THEN role END AS model,
  CAST(NULL AS VARCHAR) AS occupation FROM conversations"""


@query(TURNS)
def csv_snapshot(spark, folder):
    path = new_folder(spark, "snapshot")
    sinks.write_snapshot(_turns(spark, folder), path)
    return readers.read_log_csv(spark, path).select(*TURN_COLUMNS)


@query("""SELECT conv_id || '-' || turn AS persona_uuid, text AS political_interest
FROM conversations""")
def tsv_notes(spark, folder):
    path = new_folder(spark, "notes")
    notes = _turns(spark, folder).select(
        "persona_uuid", F.col("vote").alias("role"), F.col("reason").alias("political_interest"))
    notes.write.options(header=True, sep="\t", escape='"').csv(path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in notes.columns])
    return readers.read_interests(spark, path, schema)


@query(TURNS)
def document_round_trip(spark, folder):
    path = new_folder(spark, "documents")
    sinks.write_documents(_turns(spark, folder), path, "all")
    stored = readers.read_document_lines(spark, path).withColumn("response_file", F.lit(None))
    return readers.document_log(stored).select(*TURN_COLUMNS)


@query(TURNS)
def log_append(spark, folder):
    path, rows = new_folder(spark, "log"), _turns(spark, folder)
    listed = F.col("vote").isin("user", "assistant")
    runs = {"user": F.col("vote") == "user", "assistant": F.col("vote") == "assistant",
            "others": F.coalesce(~listed, F.lit(True))}
    for run in [*runs, "assistant"]:  # a repeated run replaces itself
        sinks.append_log(rows.where(runs[run]), path, run)
    return readers.read_log(spark, path).select(*TURN_COLUMNS)


@query("""SELECT md5(CAST(c_custkey AS VARCHAR)) AS uuid, c_mktsegment AS occupation,
  CAST(c_nationkey + 20 AS INTEGER) AS age, CAST(NULL AS VARCHAR) AS hobbies_and_interests
FROM customer""")
def persona_scan(spark, folder):
    path = new_folder(spark, "personas")
    people = table(spark, folder, "customer").select(
        F.md5(F.col("c_custkey").cast("string")).alias("uuid"),
        (F.col("c_nationkey") + 20).cast("int").alias("age"),
        F.col("c_mktsegment").alias("occupation"))
    readers.with_missing(people, schemas.PERSONA).repartition(9).write.parquet(path)
    return readers.read_personas(spark, path).select(
        "uuid", "occupation", "age", "hobbies_and_interests")


# Objects in one document file; the number of files grows with the table.
PER_FILE = 100


@query("""SELECT 'customer ' || c_custkey AS persona_uuid, c_mktsegment AS vote, c_name AS reason
FROM customer""")
def document_files(spark, folder):
    # Objects over several lines, many to a file; each file is one array.
    path = new_folder(spark, "document-files")
    text = F.format_string(
        '{\n  "persona_uuid": "customer %d",\n  "political_interest": NaN,\n'
        '  "parsed": {"vote": "%s",\n "reason": "%s"}\n}', "c_custkey", "c_mktsegment", "c_name")
    files = table(spark, folder, "customer").groupBy(
        F.floor(F.col("c_custkey") / PER_FILE).alias("part")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(text), ",\n"), F.lit("]")).alias("value"))
    files.repartition("part").write.partitionBy("part").text(path)
    stored = readers.read_documents(spark, f"{path}/*")
    return readers.document_log(stored).where("political_interest IS NULL").select(
        "persona_uuid", "vote", "reason")


@query("""SELECT 'missing keys: []' AS error, 'p/m' AS model, 's' || s_suppkey AS persona_uuid,
  s_name || chr(10) || 'second line' || chr(10) AS raw_response, 'm' AS model_name
FROM supplier""")
def failure_files(spark, folder):
    path = new_folder(spark, "failure-files")
    sinks.write_named(table(spark, folder, "supplier").select(
        F.format_string("FAIL_%d.txt", "s_suppkey").alias("name"),
        F.format_string("=== ERROR: missing keys: []\n=== MODEL: p/m\n=== UUID: s%d\n\n"
                        "%s\nsecond line", "s_suppkey", "s_name").alias("text")), path)
    return readers.read_failures(spark, path).select(
        "error", "model", "persona_uuid", "raw_response", "model_name")


@query("""SELECT k.kind, 'v' || s_suppkey AS version,
  CASE k.kind WHEN 'voter_context' THEN s_name ELSE 'of ' || s_name END || chr(10) AS text
FROM supplier, (VALUES ('voter_context'), ('system_prompt')) k(kind)""")
def asset_files(spark, folder):
    path, texts = new_folder(spark, "asset-files"), {
        "voter_context": F.col("s_name"), "system_prompt": F.concat(F.lit("of "), "s_name")}
    sinks.write_named(table(spark, folder, "supplier").select(F.inline(F.array(*[
        F.struct(F.concat(F.lit(f"{kind}_v"), "s_suppkey", F.lit(".md")).alias("name"),
                 text.alias("text")) for kind, text in texts.items()]))), path)
    return readers.read_assets(spark, path)


@query("""SELECT CAST(s_suppkey // 10 + 1 AS INTEGER) AS chunk_id,
  CAST(s_suppkey % 10 AS INTEGER) AS idx, s_name || chr(10) AS text FROM supplier""")
def note_files(spark, folder):
    key, path = F.col("s_suppkey"), new_folder(spark, "note-files")
    chunk = F.format_string("%03d", F.floor(key / 10) + 1)
    sinks.write_named(table(spark, folder, "supplier").select(
        F.concat(F.lit("_"), chunk, F.lit("_results/"), key % 10, F.lit(".txt")).alias("name"),
        F.col("s_name").alias("text")), path)
    return readers.read_notes(spark, f"{path}/*")


def _reply_files(spark, folder, path):
    """One response document per supplier, under a name that tells what is in it."""
    stamp = F.concat(F.lit("20260101-"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 6, "0"))
    sinks.write_named(table(spark, folder, "supplier").select(
        columns.response_name(
            stamp, F.when(F.col("s_suppkey") % 3 == 0, "p/m").otherwise("q/n"),
            F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0")),
            F.concat(F.lit("v"), (F.col("s_suppkey") % 4).cast("string"))).alias("name"),
        F.to_json(F.struct(
            F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("persona_uuid"),
            F.struct(F.col("s_name").alias("vote"), F.col("s_name").alias("reason")).alias("parsed"),
        )).alias("text")), path)
    return path


@query("""SELECT 's' || s_suppkey AS persona_uuid, s_name AS vote FROM supplier
WHERE s_suppkey % 3 = 0 AND s_suppkey % 4 IN (1, 2) AND s_suppkey % 1000 >= 5""")
def named_documents(spark, folder):
    # Only files whose names pass are opened.
    named = _reply_files(spark, folder, new_folder(spark, "reply-files"))
    wanted = readers.named_files(models=["p/m"], versions=["v1", "v2"], since="20260101-000005")
    stored = readers.read_documents(spark, named, wanted)
    return readers.document_log(stored).select("persona_uuid", "vote")


@query("""SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 1""")
def peek_one(spark, folder):
    first = table(spark, folder, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey")
    return readers.peek(first)


@query(f"""{CUT} SELECT 'doc-' || doc_id AS persona_uuid, lang AS model, error, raw_response
FROM parsed WHERE error IS NOT NULL""")
def dead_letter_sink(spark, folder):
    path = new_folder(spark, "dead_letters")
    replies = cut_replies(spark, folder).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("persona_uuid"),
        F.col("lang").alias("model"), "raw_response")
    sinks.write_dead_letters(split_replies(parse_replies(replies))[1], path, "all")
    letters = readers.read_or_empty(spark, path, schemas.DEAD_LETTER)
    return letters.select("persona_uuid", "model", "error", "raw_response")


@query("""SELECT s_suppkey, s_name, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) // 10 + 1
  AS INTEGER) AS chunk_id, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) % 10 AS INTEGER) AS idx
FROM supplier""")
def chunk_files(spark, folder):
    path = new_folder(spark, "chunks")
    people = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    chunked = chunk_rows(people, ["s_suppkey"])
    sinks.write_chunks(chunked, path, chunks_per_folder=25)
    return spark.read.schema(chunked.schema).json(path).select(*chunked.columns)


@query(f"""WITH {LOG} SELECT persona AS persona_uuid, model, vote AS vote_now,
  CAST(NULL AS INTEGER) AS age FROM log""")
def projected_log(spark, folder):
    view = log(spark, folder).select(F.col("persona").alias("persona_uuid"), "model", "vote")
    wanted = T.StructType([*view.schema.fields, T.StructField("age", T.IntegerType())])
    return columns.with_suffix(readers.with_missing(view, wanted), ["vote"], "now")


@query(f"""WITH {LOG} SELECT persona AS persona_uuid, model, vote FROM log""")
def first_append(spark, folder):
    # The log to append to is not there yet and reads as empty.
    new = log(spark, folder).select(F.col("persona").alias("persona_uuid"), "model", "vote")
    old = readers.read_or_empty(spark, new_folder(spark, "absent"), new.schema)
    return sets.append(old, new)
