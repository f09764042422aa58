import hashlib

import pytest
from pyspark.sql import functions as F

from panelkit.operators import joins, numbering, sampling


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@pytest.fixture(scope="module")
def people(spark):
    """One stratum holds two thirds of the rows, one a single row, one is null."""
    def stratum(i):
        return "one" if i == 7 else None if i % 11 == 0 else "hot" if i % 3 else "cold"

    values = [(i, stratum(i)) for i in range(5000)]
    return spark.createDataFrame(values, "k bigint, s string").repartition(7), values


@pytest.mark.parametrize("n", [1, 50, 100, 101, 4999, 9000])
def test_sample_is_the_first_by_hash(people, n):
    df, values = people
    want = {k for k, _ in sorted(values, key=lambda v: md5(3, v[0]))[:n]}
    for few in (sampling.FEW, 0):
        got = [r.k for r in sampling.sample_n(df, "k", n, 3, few).collect()]
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("n,digits", [(1, 1), (100, 1), (100, 3), (1000, 2), (10_000, 4)])
def test_stratified_sample(people, n, digits):
    df, values = people
    want = set()
    for s in {s for _, s in values}:
        group = sorted((k for k, t in values if t == s), key=lambda k: md5(3, k))
        want |= {(k, s) for k in group[:n]}
    for few in (sampling.FEW_PER_GROUP, 0):
        drawn = sampling.sample_per_stratum(df, "s", "k", n, 3, digits, few)
        got = [tuple(r) for r in drawn.collect()]
        assert len(got) == len(want) and set(got) == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_samples_are_one_pass(spark, tmp_path, people):
    """One scan and a top-n; groups are cut to n rows in each task before the shuffle."""
    people[0].write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    plan = _plan(sampling.sample_n(df, "k", 100, 3))
    assert plan.count("FileScan") == 1 and "TakeOrderedAndProject" in plan
    assert "Exchange" not in plan and "Window" not in plan
    plan = _plan(sampling.sample_per_stratum(df, "s", "k", 100, 3))
    lines = plan.splitlines()
    partial = next(i for i, x in enumerate(lines) if "WindowGroupLimit" in x and "Partial" in x)
    assert any("Exchange" in x for x in lines[:partial])


@pytest.mark.parametrize("n", [0, 9, 10, 11, 1000])
def test_chunks(spark, n):
    df = spark.range(n).select((F.col("id") * 3).alias("k")).repartition(5)
    got = sorted(tuple(r) for r in numbering.chunk_rows(df, ["k"]).collect())
    assert got == [(i * 3, i // 10 + 1, i % 10) for i in range(n)]


def test_numbers_follow_string_order(spark):
    df = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("k"))
    got = sorted((r.n, r.k) for r in numbering.number_rows(df, ["k"], "n").collect())
    assert [k for _, k in got] == sorted(k for _, k in got)
    assert [n for n, _ in got] == list(range(3000))


def test_notes_attach_to_chunks(spark, rows):
    chunked = numbering.chunk_rows(spark.range(12).withColumnRenamed("id", "k"), ["k"])
    notes = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (9, 9, "c")],
                                  "chunk_id int, idx int, text string")
    got = joins.attach_notes(chunked, notes).select("k", "text")
    assert rows(got) == [(0, "a"), (11, "b")]


def test_draws_repeat_and_follow_the_shards(people):
    df, values = people
    df = df.where("s is not null")
    shards = {s: sorted(k for k, t in values if t == s) for s in ("cold", "hot", "one")}
    got = {r.draw: (r.s, r.k) for r in sampling.draw_with_repeats(df, "s", "k", 300, 4).collect()}
    want = {}
    for i in range(300):
        name = sorted(shards)[int(md5(4, "shard", i)[:12], 16) % 3]
        want[i] = (name, shards[name][int(md5(4, "row", i)[:12], 16) % len(shards[name])])
    assert got == want
    assert sum(v == ("one", 7) for v in got.values()) > 50


def test_run_grid(people):
    df, values = people
    got = sampling.run_grid(df, "k", [("m", "v1", 5), ("m", "v2", 7)], 1)
    assert got.groupBy("version").count().orderBy("version").collect() == [("v1", 5), ("v2", 7)]
    want = {k for k, _ in sorted(values, key=lambda v: md5("1", "m", "v1", v[0]))[:5]}
    assert {r.k for r in got.where("version = 'v1'").collect()} == want


def test_sample_joins_nothing(people):
    df = sampling.sample_n(people[0], "k", 50, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_cells_and_strata_do_not_shuffle_whole_rows(spark, people):
    """Only keys are exchanged on cell or stratum, also without automatic broadcasts."""
    wide = people[0].withColumn("body", F.repeat(F.lit("x"), 100))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (sampling.run_grid(wide, "k", [("m", "v1", 5), ("m", "v2", 7)]),
                   sampling.sample_per_stratum(wide, "s", "k", 5)):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            joins_on_key = [line for line in plan.splitlines() if "Join Inner" in line]
            assert "(k#" in joins_on_key[0], "whole rows meet the drawn keys on the key"
            below = plan.split(joins_on_key[1], 1)[1] if len(joins_on_key) > 1 else ""
            assert "repeat" not in below and df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_feed_and_head(spark):
    df = spark.range(20).repartition(3)
    assert [r.id for r in sampling.recent(df, ["id"], 3).collect()] == [19, 18, 17]
    assert [r.id for r in sampling.head(df, ["id"], 2).collect()] == [0, 1]
    some = spark.createDataFrame([(1, 5), (2, None), (3, 6), (4, None), (5, None)], "i int, o int")
    assert [r.o for r in sampling.head(some, ["o", "i"], 3).collect()] == [5, 6, None]
    assert [r.o for r in sampling.recent(some, ["o", "i"], 4).collect()] == [6, 5, None, None]
