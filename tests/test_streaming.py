"""The streamed tables equal the batch ones, over several batches and a restart."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions.columns import log_order
from panelkit.functions.parse import parse_replies
from panelkit.operators import metrics
from panelkit.operators.dedupe import keep_last
from panelkit.streaming import levels, live
from test_log_operators import SCHEMA, make_log


@pytest.fixture()
def source(spark, tmp_path):
    """A folder that receives three files of a log, one per call."""
    parts = [make_log(spark, 150, seed)[0] for seed in (11, 12, 13)]
    folder = str(tmp_path / "in")

    def add(i):
        parts[i].coalesce(1).write.mode("append").parquet(folder)

    add(0)
    return folder, add


def run_twice(spark, source, start):
    """Start, add files, start again from the same checkpoint."""
    folder, add = source
    for i in (None, 1, 2):
        if i is not None:
            add(i)
        stream = live.read_stream(spark, folder, spark.read.parquet(folder).schema)
        start(stream).awaitTermination()
    return spark.read.parquet(folder)


def test_totals(spark, source, tmp_path, rows):
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    batch = run_twice(spark, source, lambda s: live.live_totals(
        s, ["model", "vote"], path, state, refresh=None))
    want = batch.dropna(subset=["model", "vote"]).groupBy("model", "vote").agg(
        F.count(F.lit(1)), metrics.exact_mean("elapsed_sec"))
    assert rows(live.read_totals(spark, path)) == rows(want)


def test_distinct(spark, source, tmp_path, rows):
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    batch = run_twice(spark, source, lambda s: live.live_distinct(
        s, ["model", "persona_uuid"], path, state, refresh=None))
    want = batch.agg(F.countDistinct("model"), F.countDistinct("persona_uuid")).first()
    assert rows(live.read_distinct(spark, path)) == [("model", want[0]), ("persona_uuid", want[1])]


def test_latest(spark, source, tmp_path, rows):
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    keys = ["persona_uuid", "model", "voter_context_version"]
    batch = run_twice(spark, source, lambda s: live.live_latest(
        s, keys, log_order(), path, state, refresh=None))
    want = keep_last(batch, keys, log_order()).select(*keys, "response_file")
    got = live.read_latest(spark, path, keys, batch.schema, log_order())
    assert got.columns == batch.columns
    assert rows(got.select(*keys, "response_file")) == rows(want)


def test_levels_bound_the_parts_and_repeat_safely(spark, tmp_path, rows):
    """Late rows lose, a batch that runs again changes nothing, readers open few parts."""
    path = str(tmp_path / "out")
    schema = T.StructType().add("key", "long").add("_order", "long").add("value", "string")
    merge = live._newest(["key"])
    batches = [[(k, (7 * b + k) % 50, f"{b}-{k}") for k in range(b % 5, 20)] for b in range(14)]
    every = []
    for b, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, schema).coalesce(1)
        for _ in range(2 if b in (3, 8) else 1):
            levels.add_batch(merge(frame), path, b, merge, width=3)
        every += batch
        assert len(levels.live_parts(spark, path)) <= 2 * 3
    best = {}
    for key, order, _ in every:
        best[key] = max(order, best.get(key, -1))
    got = merge(levels.read_levels(spark, path, schema)).select("key", "_order")
    assert rows(got) == sorted(best.items(), key=repr)


def test_a_half_written_batch_is_not_read(spark, source, tmp_path, rows):
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    run_twice(spark, source, lambda s: live.live_totals(
        s, ["model", "vote"], path, state, refresh=None))
    whole = rows(live.read_totals(spark, path))
    spark.createDataFrame([("x", "y", 1, 1, Decimal(1))], "model string, vote string, count long, "
                          "timed long, time decimal(38,18)").write.parquet(f"{path}/batch=99")
    assert rows(live.read_totals(spark, path)) == whole


def test_distinct_with_a_clock_that_stands_still(spark, source, tmp_path, rows):
    """No time is read: batches of one instant, and values that come again and again."""
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    folder, add = source
    stream = live.read_stream(spark, folder, spark.read.parquet(folder).schema, maxFilesPerTrigger=1)
    add(0), add(1), add(0)
    query = live.live_distinct(stream, ["vote", "model"], path, state, refresh=None)
    query.awaitTermination()
    assert len(query.recentProgress) >= 4
    batch = spark.read.parquet(folder).agg(F.countDistinct("model"), F.countDistinct("vote")).first()
    assert rows(live.read_distinct(spark, path)) == [("model", batch[0]), ("vote", batch[1])]


def test_ingest_parses_each_file_once(spark, tmp_path, rows):
    folder, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    replies = spark.createDataFrame(
        [(1, '{"vote": "A", "reason": "b"}'), (2, "nothing")], "i int, raw_response string")
    for part in (replies.where("i = 1"), replies.where("i = 2")):
        part.write.mode("append").json(folder)
        stream = live.read_stream(spark, folder, replies.schema, "json")
        live.ingest(stream, path, state, refresh=None, transform=parse_replies).awaitTermination()
    got = spark.read.parquet(path).drop("batch")
    assert rows(got) == rows(parse_replies(replies))


def test_log_schema_is_the_batch_one(spark, source):
    folder, _ = source
    stream = live.read_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema)
    assert stream.isStreaming and stream.columns == spark.read.parquet(folder).columns
