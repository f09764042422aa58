"""Writers for the log, documents, dead letters, snapshots, chunks and summaries.

Tables that grow take a run name. A run writes its own part of the table, so a run
that is repeated after a failure replaces its rows and never doubles them. Under the name
of an attempt as well, a part is seen only once ``published`` names that attempt.
"""

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit import schemas
from panelkit.sources.readers import with_missing

LOG_PARTITIONS = ("model", "voter_context_version")


def _part(path: str, run: str, attempt: str | None = None) -> str:
    return f"{path}/run={run}" + (f"/attempt={attempt}" if attempt else "")


def append_log(df: DataFrame, path: str, run: str,
               partitions: Sequence[str] = LOG_PARTITIONS, attempt: str | None = None) -> None:
    """Add a run's rows to the parquet log.

    The rebalance hint lets adaptive execution merge small writes and split the
    partition of a model that holds most of the rows.
    """
    rows = with_missing(df, schemas.RESPONSE_LOG)
    (rows.hint("rebalance", *partitions).write.mode("overwrite")
     .partitionBy(*partitions).parquet(_part(path, run, attempt)))


def documents(df: DataFrame) -> DataFrame:
    """Flat answered rows as nested response documents."""
    def group(schema_field: str):
        names = schemas.RESPONSE_DOCUMENT[schema_field].dataType.names
        return F.struct(*names).alias(schema_field)

    flat = [f.name for f in schemas.RESPONSE_DOCUMENT.fields
            if f.name not in ("persona", "parsed")]
    full = with_missing(df, schemas.RESPONSE_LOG) if "persona_summary" not in df.columns else df
    for name in flat:
        if name not in full.columns:
            full = full.withColumn(name, F.lit(None).cast("string"))
    columns = {n: n for n in flat} | {"persona": group("persona"), "parsed": group("parsed")}
    return full.select(*[columns[n] for n in schemas.RESPONSE_DOCUMENT.names])


def write_documents(df: DataFrame, path: str, run: str, attempt: str | None = None) -> None:
    """One JSON document per line, many per file."""
    documents(df).write.mode("overwrite").json(_part(path, run, attempt))


def write_dead_letters(df: DataFrame, path: str, run: str, attempt: str | None = None) -> None:
    with_missing(df, schemas.DEAD_LETTER).write.mode("overwrite").parquet(
        _part(path, run, attempt))


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace a CSV snapshot; quotes are doubled, so line breaks inside fields survive."""
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_chunks(df: DataFrame, path: str, fmt: str = "json", chunks_per_folder: int = 1) -> None:
    """Chunked rows, one folder per ``chunks_per_folder`` chunks.

    One folder per chunk of ten suits a hand-out; raise the number for large
    panels. The range shuffle brings a chunk's rows together, sorted.
    """
    folder = (F.floor((F.col("chunk_id") - 1) / chunks_per_folder) + 1).cast("int")
    rows = (
        df.withColumn("chunk_folder", folder)
        .repartitionByRange("chunk_folder").sortWithinPartitions("chunk_folder", "chunk_id", "idx")
    )
    writer = rows.write.mode("overwrite").partitionBy("chunk_folder")
    if fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.options(header=True, escape='"').csv(path)


def write_summary(df: DataFrame, path: str, run: str, attempt: str | None = None) -> None:
    """Metrics of a run."""
    df.write.mode("overwrite").json(_part(path, run, attempt))


def write_named(df: DataFrame, path: str, name: str = "name", text: str = "text") -> int:
    """Write texts as files of their own names, and return the number of files.

    ``name`` is the file's path under ``path``; the rows that share one are its lines, in
    order, and a null text is an empty line. The tasks write the files themselves, each
    beside its place and then moved there, so a task that runs again replaces its files.
    Spark's own writer would make a folder per file and move each from the driver.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = df.select(F.col(name).alias("name"), F.col(text).alias("text"))

    files, root = pafs.FileSystem.from_uri(path)
    files.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(path)
        beside = f"_{uuid.uuid4().hex}"
        last, folder, out, written = None, None, None, 0

        def close():
            out.close()
            files.move(f"{folder}/{beside}", f"{root}/{last}")

        for rows in batches:
            for file, line in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if file is None:
                    raise ValueError("a file needs a name")
                if file != last:
                    if out:
                        close()
                    place = f"{root}/{file}".rpartition("/")[0]
                    if place != folder:
                        files.create_dir(place, recursive=True)
                    last, folder, written = file, place, written + 1
                    out = files.open_output_stream(f"{folder}/{beside}")
                out.write(f"{line or ''}\n".encode())
        if out:
            close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    placed = lines.repartition(tasks, "name").sortWithinPartitions("name", "text")
    counted = placed.mapInArrow(write, "files long").agg(F.coalesce(F.sum("files"), F.lit(0)))
    return counted.first()[0]
