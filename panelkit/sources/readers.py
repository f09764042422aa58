"""Readers for the panel, the response log, documents, failures, notes and prompt texts.

Schemas are given, never inferred, so a read starts no extra job. A folder or
table that may not exist yet reads as empty.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from panelkit import schemas
from panelkit.functions.columns import key_prefix, response_name_parts, safe_name, utc_name

FAILURE_TEXT = r"(?s)^=== ERROR: (.*?)\n=== MODEL: (.*?)\n=== UUID: (.*?)\n\n(.*)\z"
ASSET_NAME = r"^(voter_context|system_prompt)_(v\d+)\.md$"
NOTE_PATH = r"_(\d+)_results/(\d+)\.txt$"


def read_personas(spark: SparkSession, path: str, schema: T.StructType = schemas.PERSONA
                  ) -> DataFrame:
    """The panel's parquet shards; only the columns a query uses are read."""
    return spark.read.schema(schema).parquet(path)


def _read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str) -> DataFrame:
    df = (
        spark.read.schema(schema)
        .options(header=True, multiLine=True, escape='"', sep=sep, encoding="UTF-8",
                 enforceSchema=False)
        .csv(path)
    )
    first = schema.names[0]
    return df.withColumn(first, F.regexp_replace(first, r"^\ufeff", ""))


def read_log_csv(spark: SparkSession, path: str, zone: str | None = None) -> DataFrame:
    """The response log as CSV: byte-order mark, doubled quotes, line breaks inside fields.

    ``zone`` is the time zone of the stamps its file names begin with, if not UTC.

    Such a file cannot be split, so one task reads it. Use it to bring a log in
    once; the parquet log is the table to query.
    """
    rows = _read_csv(spark, path, schemas.RESPONSE_LOG, ",")
    return rows.withColumn("response_file", utc_name("response_file", zone)) if zone else rows


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The parquet log of all runs, partitioned by model and version."""
    log = spark.read.schema(schemas.RESPONSE_LOG).parquet(path)
    return log.select(*schemas.RESPONSE_LOG.names)


def read_interests(spark: SparkSession, path: str,
                   schema: T.StructType = schemas.INTERESTS) -> DataFrame:
    """Interest notes from tab-separated text; ``schema`` lists the file's columns."""
    return _read_csv(spark, path, schema, "\t").select("persona_uuid", "political_interest")


def named_files(models: Sequence[str] | None = None, versions: Sequence[str] | None = None,
                personas: Sequence[str] | None = None, since: str | None = None,
                until: str | None = None) -> Column:
    """A test on the name of a response or failure file, by what the name tells.

    A name starts with the time of its reply and carries the model, the first characters of
    the persona's key and both versions. ``since`` and ``until`` are such times, the second
    not included; ``versions`` are those of the context. As the test needs the file's name
    only, Spark makes it on the listing of the folder, and opens no file that fails it.
    """
    parts = response_name_parts("_metadata.file_name")
    test = F.lit(True)
    if models is not None:
        test = test & parts["model"].isin([safe_name(F.lit(m)) for m in models])
    if versions is not None:
        test = test & parts["voter_context_version"].isin(list(versions))
    if personas is not None:
        test = test & parts["key8"].isin([key_prefix(F.lit(p)) for p in personas])
    if since is not None:
        test = test & (parts["timestamp"] >= since)
    if until is not None:
        test = test & (parts["timestamp"] < until)
    return F.coalesce(test, F.lit(False))


def read_documents(spark: SparkSession, path: str, files: Column | None = None) -> DataFrame:
    """Response documents of any of the three layouts, one object per file.

    ``files`` (of ``named_files``) leaves out files by their names, unopened; many small
    files are packed into a task by their bytes. A missing note was written as a bare
    ``NaN``; it reads as null.
    """
    df = spark.read.schema(schemas.RESPONSE_DOCUMENT).option("multiLine", True).json(path)
    df = df if files is None else df.where(files)
    note = F.col("political_interest")
    return df.withColumn("political_interest", F.when(note != "NaN", note)).withColumn(
        "response_file", F.col("_metadata.file_name"))


def read_document_lines(spark: SparkSession, path: str) -> DataFrame:
    """Documents as ``write_documents`` stores them: one per line, many per file."""
    return spark.read.schema(schemas.RESPONSE_DOCUMENT).json(path).select(
        *schemas.RESPONSE_DOCUMENT.names)


def document_log(documents: DataFrame) -> DataFrame:
    """Flat rows of response documents, under the log's column names."""
    return documents.select(
        "persona_uuid", "persona.*", "parsed.*", "model", "elapsed_sec", "response_file",
        "voter_context_version", "system_prompt_version", "political_interest", "raw_response",
        "timestamp",
    )


def read_failures(spark: SparkSession, path: str, files: Column | None = None) -> DataFrame:
    """Failure texts as dead letters; ``files`` leaves out files by their names, unopened.

    Some files name the model without its provider; the file name carries a
    provider only when the text does, so both forms are kept as they are and
    ``model_name`` holds the part after the provider.
    """
    read = spark.read.text(path, wholetext=True)
    text = (read if files is None else read.where(files)).select(
        "value", F.col("_metadata.file_name").alias("file_name"))
    parts = response_name_parts("file_name")

    def part(group: int):
        return F.regexp_extract("value", FAILURE_TEXT, group)

    return text.select(
        "file_name", part(1).alias("error"), part(2).alias("model"),
        part(3).alias("persona_uuid"), part(4).alias("raw_response"),
        F.substring_index(part(2), "/", -1).alias("model_name"),
        parts["timestamp"].alias("timestamp"),
        parts["voter_context_version"].alias("version"),
    )


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """Prompt texts as (kind, version, text); other files in the folder are left out."""
    name = F.col("_metadata.file_name")
    return (
        spark.read.text(path, wholetext=True)
        .where(name.rlike(ASSET_NAME))
        .select(F.regexp_extract(name, ASSET_NAME, 1).alias("kind"),
                F.regexp_extract(name, ASSET_NAME, 2).alias("version"),
                F.col("value").alias("text"))
    )


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Note files ``_NNN_results/<idx>.txt`` as (chunk_id, idx, text)."""
    file = F.col("_metadata.file_path")
    return (
        spark.read.text(path, wholetext=True)
        .where(file.rlike(NOTE_PATH))
        .select(F.regexp_extract(file, NOTE_PATH, 1).cast("int").alias("chunk_id"),
                F.regexp_extract(file, NOTE_PATH, 2).cast("int").alias("idx"),
                F.col("value").alias("text"))
    )


def peek(df: DataFrame) -> DataFrame:
    """One record, without reading the rest."""
    return df.limit(1)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, reader=None) -> DataFrame:
    """The table at a path, or an empty one of the schema where there is none yet."""
    try:
        return (reader or (lambda s, p: s.read.schema(schema).parquet(p)))(spark, path)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def with_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The table with every column of the schema, absent ones as typed nulls."""
    return df.select(*[
        F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
