"""Deduplication, counts, comparison and joins on small invented logs."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.functions.columns import log_order
from panelkit.operators import compare, filters, joins, metrics, sets
from panelkit.operators.dedupe import keep_first, keep_last

SCHEMA = ("persona_uuid string, model string, voter_context_version string, vote string, "
          "reason string, elapsed_sec double, response_file string")


def make_log(spark, n=400, seed=3):
    """A log in which one persona holds a third of the rows and keys may be null."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        persona = "hot" if i % 3 == 0 else f"p{rng.randrange(40)}"
        rows.append((
            persona, rng.choice(["g", "g", "h", None]), rng.choice(["v2", "v3", "v4", None]),
            rng.choice(["A", "B", "C", None]), f"r{i}", rng.choice([None, i / 1000]),
            f"20260428-{rng.randrange(100000, 100060)}_{i:04d}.json"))
    return spark.createDataFrame(rows, SCHEMA), pd.DataFrame(
        rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


@pytest.fixture(scope="module")
def data(spark):
    return make_log(spark)


def in_order(pdf):
    return pdf.sort_values("response_file", key=lambda s: s.str[:15] + s)


@pytest.mark.parametrize("keep,operator", [("first", keep_first), ("last", keep_last)])
def test_keep_one(data, rows, keep, operator):
    df, pdf = data
    want = in_order(pdf).drop_duplicates("persona_uuid", keep=keep)
    got = operator(df, ["persona_uuid"], log_order())
    assert got.columns == df.columns
    assert {r.persona_uuid: r.response_file for r in got.collect()} == dict(
        zip(want.persona_uuid, want.response_file))


def wide_by_pandas(pdf, cells, how):
    out = None
    for name, (m, v) in cells.items():
        sub = in_order(pdf[(pdf.model == m) & (pdf.voter_context_version == v)])
        sub = sub.drop_duplicates("persona_uuid", keep="last")[["persona_uuid", "vote"]]
        sub = sub.rename(columns={"vote": f"vote_{name}"})
        out = sub if out is None else out.merge(sub, on="persona_uuid", how=how)
    return sorted((tuple(None if pd.isna(x) else x for x in r) for r in out.values), key=repr)


CELLS = {"v2": ("g", "v2"), "v3": ("g", "v3"), "h4": ("h", "v4"), "none": ("h", "v9")}


@pytest.mark.parametrize("base,how", [("v2", "left"), (None, "outer")])
def test_wide_compare(data, rows, base, how):
    df, pdf = data
    got = compare.wide_compare(df, CELLS, log_order(), values=("vote",), base=base)
    assert got.columns == ["persona_uuid", "vote_v2", "vote_v3", "vote_h4", "vote_none"]
    assert rows(got) == wide_by_pandas(pdf, CELLS, how)


def test_base_columns_come_from_the_base(data):
    df, _ = data
    got = compare.wide_compare(df, CELLS, log_order(), base="v2", base_columns=["elapsed_sec"])
    kept = keep_last(filters.where_equal(df, model="g", voter_context_version="v2"),
                     ["persona_uuid"], log_order())
    a = {r.persona_uuid: (r.elapsed_sec, r.vote_v2, r.reason_v2) for r in got.collect()}
    assert a == {r.persona_uuid: (r.elapsed_sec, r.vote, r.reason) for r in kept.collect()}


def test_inner_pair_keeps_first(data, rows):
    df, pdf = data
    sides = []
    for v in ("v2", "v3"):
        sub = in_order(pdf[(pdf.model == "g") & (pdf.voter_context_version == v)])
        sides.append(sub.drop_duplicates("persona_uuid")[["persona_uuid", "vote"]])
    want = sides[0].merge(sides[1], on="persona_uuid")
    got = compare.inner_pair(df, ("v2", ("g", "v2")), ("v3", ("g", "v3")), log_order(),
                             values=("vote",))
    plain = want.astype(object).where(want.notna(), None)
    assert rows(got) == sorted((tuple(r) for r in plain.values), key=repr)


def pairs(spark, values):
    return spark.createDataFrame(values, "a string, b string")


PAIRS = [("A", "A"), ("A", "B"), ("B", "A"), (None, "A"), ("A", None), ("All", "A"), ("C", "C")]


def test_change_rate(spark):
    row = compare.change_rate(pairs(spark, PAIRS), "a", "b").first()
    assert tuple(row) == (5, 3, 60.0)
    assert tuple(compare.change_rate(pairs(spark, []), "a", "b").first()) == (0, 0, None)


def test_transitions(spark, rows):
    pdf = pd.DataFrame(PAIRS[:5] + PAIRS[6:], columns=["a", "b"]).dropna()
    cross = pd.crosstab(pdf.a, pdf.b, margins=True)
    df = pairs(spark, PAIRS[:5] + PAIRS[6:])
    long = compare.transition_matrix(df, "a", "b").collect()
    for r in long:
        assert cross.loc[r.a, r.b] == r["count"]
    assert len(long) == int((cross != 0).sum().sum())
    wide = {r.a: r for r in compare.transition_table(df, "a", "b", ["A", "B", "C"]).collect()}
    assert {(a, b): wide[a][b] for a in wide for b in cross.columns} == {
        (a, b): cross.loc[a, b] for a in cross.index for b in cross.columns}
    assert all(r["(other)"] == 0 for r in wide.values())
    part = {r.a: r for r in compare.transition_table(df, "a", "b", ["A"]).collect()}
    for a in part:
        assert part[a]["A"] + part[a]["(other)"] == part[a]["All"] == cross.loc[a, "All"]


def test_an_answer_named_as_the_total(spark):
    df = pairs(spark, PAIRS)
    with pytest.raises(Exception, match="choose another total name"):
        compare.transition_matrix(df, "a", "b").collect()
    got = {(r.a, r.b): r["count"] for r in compare.transition_matrix(
        df, "a", "b", total="total").collect()}
    assert got["All", "A"] == 1 and got["total", "total"] == 5
    flags = compare.transition_cube(df, "a", "b").where("a = 'All' and not all_before")
    assert flags.count() == 2


def test_null_answers_are_not_totals(spark):
    got = compare.transition_matrix(pairs(spark, [(None, None), ("A", "B")]), "a", "b").collect()
    assert sorted(map(tuple, got)) == [
        ("A", "All", 1), ("A", "B", 1), ("All", "All", 1), ("All", "B", 1)]


def test_changed_and_unchanged(spark):
    df = pairs(spark, PAIRS)
    assert df.where(filters.changed("a", "b")).count() == 3
    assert df.where(filters.unchanged("a", "b")).count() == 2
    assert filters.complete(df, "a", "b").count() == 5


def test_cell_distributions(data, rows):
    df, pdf = data
    cells = [("g", "v2"), ("h", "v4"), ("h", "v9")]
    want = Counter()
    for m, v in cells:
        sub = in_order(pdf[(pdf.model == m) & (pdf.voter_context_version == v)])
        for vote in sub.drop_duplicates("persona_uuid", keep="last").vote.dropna():
            want[m, v, vote] += 1
    got = compare.cell_distributions(df, cells, log_order())
    assert rows(got) == sorted(((*k, n) for k, n in want.items()), key=repr)


def test_kpi(data, spark):
    df, pdf = data
    row = metrics.kpi(df).first()
    assert (row.n_rows, row.n_models, row.n_personas) == (
        len(pdf), pdf.model.nunique(), pdf.persona_uuid.nunique())
    assert row.mean_latency == pytest.approx(pdf.elapsed_sec.mean())
    assert tuple(metrics.kpi(df.where("false")).first()) == (0, 0, None, 0)


def test_group_size_and_share(data, rows):
    df, pdf = data
    size = pdf.groupby(["model", "voter_context_version", "vote"]).size().reset_index(name="count")
    keys = ["model", "voter_context_version", "vote"]
    assert rows(metrics.group_size(df, keys)) == sorted((tuple(r) for r in size.values), key=repr)
    size["pct"] = size.groupby(keys[:2])["count"].transform(lambda x: x / x.sum() * 100)
    got = {tuple(r)[:4]: r.pct for r in metrics.share_of_group(df, keys[:2], "vote").collect()}
    assert got == {tuple(r)[:4]: r[4] for r in size.values}


def test_dense_cross_count(spark):
    pdf = pd.DataFrame({"band": ["x", "x", None, "z"], "vote": ["A", "B", "C", None]})
    pdf["band"] = pd.Categorical(pdf.band, ["x", "y", "z"], ordered=True)
    want = pdf.groupby(["band", "vote"], observed=False).size().reindex(
        pd.MultiIndex.from_product([["x", "y", "z"], ["A", "B", "C"]]), fill_value=0)
    df = spark.createDataFrame(
        [("x", "A"), ("x", "B"), (None, "C"), ("z", None)], "band string, vote string")
    got = metrics.cross_count(df, "band", "vote", ["x", "y", "z"]).collect()
    assert {(r.band, r.vote): r["count"] for r in got} == want.to_dict()


def test_mean_count_and_value_counts(data):
    df, pdf = data
    want = pdf.groupby("model").elapsed_sec.agg(["mean", "count"])
    for r in metrics.mean_count(df, ["model"]).collect():
        assert r["count"] == want.loc[r.model, "count"]
        assert r["mean"] == pytest.approx(want.loc[r.model, "mean"])
    counts = pdf.vote.value_counts()
    got = metrics.value_counts(df, "vote").collect()
    assert [(r.vote, r["count"]) for r in got] == sorted(
        counts.items(), key=lambda p: (-p[1], p[0]))
    shares = {r.vote: (r.pct, r.bar_pct) for r in metrics.share_of_total(df, "vote").collect()}
    assert shares == {v: (n / counts.sum() * 100, n / counts.max() * 100)
                      for v, n in counts.items()}


def test_mean_of_nothing(spark, rows):
    df = spark.createDataFrame([("a", None), ("b", 1.5)], "model string, elapsed_sec double")
    assert rows(metrics.mean_count(df, ["model"])) == [("a", None, 0), ("b", 1.5, 1)]


def test_exact_mean_is_independent_of_order(spark):
    values = [0.1 * i for i in range(1, 2000)] + [1e9, -1e9 + 0.001]
    df = spark.createDataFrame([(round(v, 3),) for v in values], "x double")
    got = {df.repartition(n).agg(metrics.exact_mean("x")).first()[0] for n in (1, 3, 7)}
    assert len(got) == 1


def test_small_values_keep_their_decimals(spark):
    df = spark.createDataFrame([(0.0004,), (0.0006,)], "x double")
    assert df.agg(metrics.exact_mean("x")).first()[0] == 0.0005


def test_success_rate_and_summary(spark, rows):
    df = spark.createDataFrame([("m", None, 1.0), ("m", "e", None), ("n", "e", 2.0)],
                               "model string, error string, elapsed_sec double")
    good, bad = df.where("error is null"), df.where("error is not null")
    assert rows(metrics.success_rate(good, bad, ["model"])) == [("m", 2, 1, 0.5), ("n", 1, 0, 0.0)]
    assert tuple(metrics.success_rate(good, bad).first()) == (3, 1, 1 / 3)
    assert rows(metrics.run_summary(df, ["model"])) == [
        ("m", 2, 1, 0.5, 1.0), ("n", 1, 0, 0.0, None)]


def test_non_null_counts(data):
    df, pdf = data
    got = metrics.non_null_counts(df, ["vote", "model"]).first()
    assert tuple(got) == (pdf.vote.notna().sum(), pdf.model.notna().sum())


def test_enrich_fans_out_and_coverage_counts(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "persona_uuid string")
    notes = spark.createDataFrame(
        [("a", "x"), ("a", "y"), ("c", None), (None, "z")],
        "persona_uuid string, political_interest string")
    joined = joins.enrich(df, notes)
    assert rows(joined) == sorted([
        ("a", "x"), ("a", "x"), ("a", "y"), ("a", "y"), ("b", None), ("c", None), (None, None)],
        key=repr)
    missing = joined.where("political_interest is null").count()
    assert tuple(joins.coverage(df, notes).first()) == (joined.count(), missing)
    assert tuple(joins.coverage(df.where("false"), notes).first()) == (0, 0)


def test_todo_cohort_difference(spark, rows):
    target = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)],
                                   "persona_uuid string, n int")
    done = spark.createDataFrame([("a",), ("a",), (None,)], "persona_uuid string")
    assert rows(joins.not_done(target, done)) == [("b", 3), (None, 4)]
    assert rows(joins.cohort(target, done)) == [("a", 1), ("a", 2)]
    assert rows(sets.difference(target, done, "persona_uuid")) == [("b",)]


def test_broadcast_only_when_small(spark):
    small = spark.range(3).withColumnRenamed("id", "k")
    assert "broadcast" in joins.broadcast_small(small, 3)._jdf.queryExecution().toString().lower()
    for limits in ((2, 1000), (3, 5)):
        plan = joins.broadcast_small(small, *limits)._jdf.queryExecution().logical().toString()
        assert "hint" not in plan.lower()


def test_lookup_join(spark, rows):
    df = spark.createDataFrame([("A",), ("Z",)], "vote string")
    colors = spark.createDataFrame([("A", "#1")], "vote string, color string")
    assert rows(joins.lookup_join(df, colors, "vote", "color", "#666")) == [
        ("A", "#1"), ("Z", "#666")]


def test_filters(spark):
    df = spark.createDataFrame([("m", "v1"), ("m", None), ("n", "v2"), (None, "v1")],
                               "model string, version string")
    assert filters.where_any_of(df, {"model": [], "version": []}).count() == 4
    assert filters.where_any_of(df, {"model": ["m"], "version": []}).count() == 2
    assert filters.where_selected(df, {"version": None}).count() == 3
    assert filters.where_selected(df, {"version": []}).count() == 0
    assert filters.where_selected(df, {"model": ["m"], "version": None}).count() == 1
    blank = df.withColumn("version", F.lit(None).cast("string"))
    assert filters.where_selected(blank, {"version": None}).count() == 4
    assert filters.where_equal(df, model="m", version="v1").count() == 1


def test_version_pair(spark):
    df = spark.createDataFrame([("v1", "v1"), ("v1", "v2"), ("v1", None), (None, None)],
                               "a string, b string")
    got = [r[0] for r in df.select(filters.version_pair_error("a", "b")).collect()]
    assert got == [None, "version pair differs: v1 / v2", "version pair differs: v1 / ?", None]


def test_options_versions_append(spark, rows):
    df = spark.createDataFrame([("b", 2), ("a", None), ("b", 1)], "x string, y int")
    got = [tuple(r) for r in sets.filter_options(df, ["y", "x"]).collect()]
    assert got == [("x", "a"), ("x", "b"), ("y", "1"), ("y", "2")]
    assets = spark.createDataFrame(
        [("voter_context", v, "t") for v in ("v2", "v10", "v9")]
        + [("system_prompt", v, "t") for v in ("v10", "v9", "v1")],
        "kind string, version string, text string")
    assert [r.version for r in sets.paired_versions(assets).collect()] == ["v9", "v10"]
    assert rows(sets.append(df, df.select("y").limit(1))) == sorted(
        [("a", None), ("b", 1), ("b", 2), (None, 2)], key=repr)
