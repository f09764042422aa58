import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit import fixed_values as fv
from panelkit.functions import columns as c


def one(spark, schema, values, *exprs):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_bucket_edges(spark):
    ages = [0, 1, 29, 30, 69, 70, 200, 201, None]
    got = one(spark, "age int", ages, c.bucket("age"))
    cut = pd.cut(pd.Series(ages, dtype="float"), bins=list(fv.AGE_EDGES), labels=list(fv.AGE_LABELS))
    assert [g[0] for g in got] == [None if pd.isna(x) else x for x in cut]


def test_bucket_rank(spark):
    got = one(spark, "b string", ["20대", "70+", "other", None], c.bucket_rank("b"))
    assert [g[0] for g in got] == [0, 5, None, None]


def test_rounding_follows_pandas(spark):
    rng = random.Random(1)
    values = [0.5, 1.5, 2.5, -0.5, 0.25, 2.675] + [rng.uniform(-100, 100) for _ in range(500)]
    values += [rng.randrange(0, 100000) / 1000 for _ in range(500)]
    for digits in (0, 1, 3):
        got = one(spark, "x double", values, c.round_half_even("x", digits))
        assert [g[0] for g in got] == list(pd.Series(values).round(digits))


def test_tenths_text_is_exact(spark):
    rng = random.Random(2)
    values = [0.25, 0.35, 0.05, 0.15, -0.25, -6.35, 1e12 + 0.05, 0.0]
    values += [rng.randrange(0, 100000) / 100 for _ in range(3000)]
    got = one(spark, "x double", values, c.tenths_text("x"))
    assert [g[0] for g in got] == [f"{x:.1f}" for x in values]


def test_safe_name_follows_unicode_words(spark):
    names = ["qwen3:32b", "ingu627/exaone4.0:32b", "한글 이름/둘", "a-b.c_d", "é½Ⅷ²ङ", "x\ny", ""]
    got = one(spark, "s string", names, c.safe_name("s"))
    assert [g[0] for g in got] == [re.sub(r"[^\w\-.]", "_", n) for n in names]


def test_names_round_trip(spark):
    df = spark.createDataFrame(
        [("20260428-142501", "gpt/한:1", "d94cda32aa", "v10", "open ai"),
         ("20260428-142501", "m_1", "d94cda32aa", None, None)],
        "t string, m string, k string, v string, p string")
    named = df.select(c.response_name("t", "m", "k", "v", "p").alias("n"))
    assert [r.n for r in named.collect()] == [
        "20260428-142501_open_ai_gpt_한_1_d94cda32_v10_v10.json",
        "20260428-142501_m_1_d94cda32.json"]
    parts = [tuple(r.p) for r in named.select(c.response_name_parts("n").alias("p")).collect()]
    assert parts == [
        (False, "20260428-142501", "open_ai_gpt_한_1", "d94cda32", "v10", "v10"),
        (False, "20260428-142501", "m_1", "d94cda32", None, None)]


def test_failure_name_parts(spark):
    got = one(spark, "n string", ["FAIL_20260429-150848_a_b-4_d8cdd6b3_v5.txt", "other.txt"],
              c.response_name_parts("n").alias("p"))
    assert tuple(got[0][0]) == (True, "20260429-150848", "a_b-4", "d8cdd6b3", "v5", None)
    assert tuple(got[1][0]) == (False, None, None, None, None, None)


def test_log_order_breaks_ties_by_name(spark):
    names = ["20260428-142502_a", "20260428-142501_b", "20260428-142501_a"]
    df = spark.createDataFrame([(n,) for n in names], "response_file string")
    assert [r[0] for r in df.orderBy(c.log_order()).collect()] == sorted(names)


def test_versions_sort_by_number(spark):
    df = spark.createDataFrame([("v10",), ("v9",), ("v2",), ("vx",)], "v string")
    got = [r.v for r in df.orderBy(c.version_number("v").asc_nulls_last()).collect()]
    assert got == ["v2", "v9", "v10", "vx"]


def test_event_time(spark):
    got = one(spark, "t string", ["20260428-142501", "soon", None],
              c.event_time("t").cast("string"))
    assert [g[0] for g in got] == ["2026-04-28 14:25:01", None, None]


def test_lookup(spark):
    got = one(spark, "v string", ["국민의힘", "new", None], c.lookup("v"))
    assert [g[0] for g in got] == ["#E61E2B", "#666", "#666"]
    many = {str(i): f"x{i}" for i in range(1001)}
    got = one(spark, "v string", ["1000", "1001", None], c.lookup("v", many))
    assert [g[0] for g in got] == ["x1000", "#666", "#666"]


def test_version_numbers_are_whole(spark):
    got = one(spark, "v string", ["v1234567890", "v20260428142501", "v007", "10", "v", "v1x", None],
              c.version_number("v").cast("string"))
    assert [g[0] for g in got] == ["1234567890", "20260428142501", "7", None, None, None, None]


def test_utc_name(spark):
    got = one(spark, "n string", ["20260428-142501_m_k_v2_v2.json", "plain.json", None],
              c.utc_name("n", "Asia/Seoul"))
    assert [g[0] for g in got] == ["20260428-052501_m_k_v2_v2.json", "plain.json", None]


def test_small_helpers(spark):
    df = spark.createDataFrame([("p", "m", None)], "p string, m string, v string")
    row = df.select(c.model_key("p", "m"), c.with_default_version("v"),
                    c.key_prefix(F.lit("0123456789")), c.preview(F.lit("한국어"), 2)).first()
    assert tuple(row) == ("p/m", "?", "01234567", "한국")
    assert c.with_suffix(df, ["m"], "v2").columns == ["p", "m_v2", "v"]


def test_facets_drop_nulls(spark, rows):
    df = spark.createDataFrame([(1, "a", None), (2, None, None)],
                               "id int, arts_persona string, travel_persona string")
    assert rows(c.facets(df, ["id"])) == [(1, "예술", "a")]
