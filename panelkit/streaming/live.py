"""The response log as a stream: ingest, running totals, distinct values, latest answers.

Nothing in a response log expires, so there is no watermark. Totals keep one entry per
group in state and distinct values one per value; latest answers keep none, since each
batch's last rows are a part of a table that is merged in levels. A batch that runs again
after a failure replaces itself in every sink.
"""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelkit.functions.columns import all_present
from panelkit.operators.dedupe import keep_last
from panelkit.operators.metrics import exact_sum
from panelkit.streaming import levels

REFRESH = "3 seconds"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                **options: object) -> DataFrame:
    """New files of a folder, each read once."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def _start(df: DataFrame, mode: str, write, checkpoint: str, refresh: str | None
           ) -> StreamingQuery:
    trigger = {"processingTime": refresh} if refresh else {"availableNow": True}
    return (
        df.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def _batch_folder(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def ingest(stream: DataFrame, path: str, checkpoint: str, refresh: str | None = REFRESH,
           transform=None) -> StreamingQuery:
    """Append each new batch to a parquet table, parsed by ``transform`` if given.

    ``refresh=None`` takes what is there and stops.
    """
    def write(rows: DataFrame, batch: int) -> None:
        rows = transform(rows) if transform else rows
        rows.write.mode("overwrite").parquet(_batch_folder(path, batch))

    return _start(stream, "append", write, checkpoint, refresh)


def live_totals(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str,
                latency: str = "elapsed_sec", refresh: str | None = REFRESH) -> StreamingQuery:
    """Rows and latency per key, refreshed whole; state is one entry per group."""
    totals = stream.where(all_present(*keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.count(latency).alias("timed"), exact_sum(latency).alias("time"),
    )

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(_batch_folder(path, batch))
        # Named last, so a reader sees a batch whole or not at all.
        rows.sparkSession.range(1).coalesce(1).write.mode("overwrite").parquet(
            f"{_ready(path)}/batch={batch}")

    return _start(totals, "complete", write, checkpoint, refresh)


def _ready(path: str) -> str:
    """Folder whose sub-folders name the batches that are wholly written."""
    return f"{path}-ready"


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the newest batch that is wholly written.

    Older folders may be removed by hand once no reader uses them.
    """
    newest = spark.read.parquet(_ready(path)).agg(F.max("batch")).first()[0]
    return spark.read.parquet(_batch_folder(path, newest)).select(
        "*", (F.col("time").cast("double") / F.col("timed")).alias("mean")
    ).drop("time", "timed")


def merge_batches(spark: SparkSession, path: str, target: str,
                  schema: T.StructType | None = None) -> None:
    """Write the batches of an ingested folder as one table of few files.

    The stream goes on in its own folder; readers change to the target when it is written.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    reader.parquet(path).hint("rebalance").write.mode("overwrite").parquet(target)


# Groups that the values of one column are dealt to; each holds its values as keyed state.
BUCKETS = 64
STORE, ROCKS = ("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FirstSeen(StatefulProcessor):
    """Counts the values of a bucket that no batch has brought before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "known boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        added = 0
        for frame in rows:
            for value in frame["value"].unique():
                if not self.seen.containsKey((value,)):
                    self.seen.updateValue((value,), (True,))
                    added += 1
        if added:
            yield pd.DataFrame({"column": [key[0]], "added": [added]})

    def close(self) -> None:
        pass


def _once_per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each value once per Arrow batch, so a value with a third of the rows sends few."""
    for batch in batches:
        yield batch.drop_duplicates()


def live_distinct(stream: DataFrame, columns: Sequence[str], path: str, checkpoint: str,
                  refresh: str | None = REFRESH, buckets: int = BUCKETS) -> StreamingQuery:
    """How many new distinct values of each column a batch brought.

    Streaming aggregation has no exact distinct count, so each value is an entry of keyed
    state, whose versions are those of the batches: no clock takes part, and a batch that
    runs again sees the state before it. Values are reduced before the shuffle, which
    streaming ``dropDuplicates`` would not do. State is kept by RocksDB, on disk.
    """
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in columns
    ])
    bucket = F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int")
    values = stream.select(F.inline(pairs)).where(F.col("value").isNotNull())
    fresh = (
        values.mapInPandas(_once_per_task, values.schema).withColumn("bucket", bucket)
        .groupBy("column", "bucket")
        .transformWithStateInPandas(FirstSeen(), "column string, added long", "Update", "None")
    )

    def write(rows: DataFrame, batch: int) -> None:
        rows.groupBy("column").agg(F.sum("added").alias("added")).write.mode(
            "overwrite").parquet(_batch_folder(path, batch))

    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKS)
    try:
        return _start(fresh, "update", write, checkpoint, refresh)
    finally:
        # A query keeps the settings it was started with.
        conf.unset(STORE) if before is None else conf.set(STORE, before)


def read_distinct(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("column").agg(F.sum("added").alias("n_distinct"))


def _newest(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: keep_last(rows, list(keys), F.col("_order"))


def live_latest(stream: DataFrame, keys: Sequence[str], order: Column, path: str, checkpoint: str,
                refresh: str | None = REFRESH, width: int = levels.WIDTH) -> StreamingQuery:
    """The last row per key by ``order``, as a table merged in levels.

    A batch adds the last row of each key it has; no state is kept. Rows that come late are
    settled by their order when parts are merged or read.
    """
    ordered = stream.withColumn("_order", order)

    def write(rows: DataFrame, batch: int) -> None:
        levels.add_batch(_newest(keys)(rows), path, batch, _newest(keys), width)

    return _start(ordered, "append", write, checkpoint, refresh)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType,
                order: Column) -> DataFrame:
    """The newest row per key of the live parts; ``schema`` and ``order`` are the stream's."""
    empty = spark.createDataFrame([], schema).withColumn("_order", order)
    rows = levels.read_levels(spark, path, empty.schema)
    return _newest(keys)(rows).drop("_order")
