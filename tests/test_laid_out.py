"""Tables in buckets of the persona's key: joins that move nothing."""

import pytest
from pyspark.sql import functions as F

from panelkit.sources import laid_out

BUCKETS = 6


@pytest.fixture()
def tables(spark, tmp_path):
    name = f"t{abs(hash(str(tmp_path)))}"
    panel = spark.range(300).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("persona_uuid"),
        F.col("id").alias("age"))
    runs = [spark.range(200).select(
        F.concat(F.lit("u"), (F.col("id") * step % 250).cast("string")).alias("persona_uuid"),
        F.when(F.col("id") % 3 == 0, "m").otherwise("n").alias("model"),
        F.lit("v2").alias("voter_context_version")) for step in (1, 3)]
    laid_out.write_laid_out(panel, f"{name}_panel", buckets=BUCKETS, path=f"{tmp_path}/panel")
    for run in runs:
        laid_out.write_laid_out(run, f"{name}_log", buckets=BUCKETS, path=f"{tmp_path}/log")
    return name, panel, runs[0].union(runs[1])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_without_an_exchange(spark, tables, rows):
    name, panel, log = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = [laid_out.read_laid_out(spark, f"{name}_{t}") for t in ("panel", "log")]
        keys = log.where("model = 'm'").select("persona_uuid").distinct()
        todo = laid_out.unanswered(*stored, "m", "v2")
        assert rows(todo) == rows(panel.join(keys, "persona_uuid", "left_anti"))
        done = laid_out.answered(*stored, "m", "v2", columns=["age"])
        assert rows(done) == rows(panel.join(keys, "persona_uuid", "left_semi"))
        assert "Exchange" not in plan(todo) and "Exchange" not in plan(done)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_layout_and_compaction(spark, tables, rows, tmp_path):
    name, _, log = tables
    assert laid_out.layout(spark, f"{name}_log") == ("persona_uuid", BUCKETS)
    assert laid_out.layout(spark, f"{name}_none") is None
    laid_out.compact(spark, f"{name}_log", f"{name}_small", f"{tmp_path}/small")
    small = laid_out.read_laid_out(spark, f"{name}_small")
    assert laid_out.layout(spark, f"{name}_small") == ("persona_uuid", BUCKETS)
    assert rows(small) == rows(log)
    assert len(small.inputFiles()) <= BUCKETS < len(spark.table(f"{name}_log").inputFiles())
    log.createOrReplaceTempView(f"{name}_plain")
    with pytest.raises(ValueError):
        laid_out.compact(spark, f"{name}_plain", f"{name}_other")
