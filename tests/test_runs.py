"""Whole runs with a fixed rule in the place of a model."""

import pytest
from pyspark.sql import functions as F

from panelkit import schemas
from panelkit.operators.infer import KEEP_EVERY, call_model, keep_replies, smoke_call
from panelkit.plans import panels, refresh, runs
from panelkit.sources import published


@pytest.fixture(scope="module")
def rule():
    """Answers by the persona's number; some replies are cut, broken or fail."""
    def factory(model, version):
        def answer(system, user):
            assert system == f"context {version} {{json}}"
            number = int(user.split("요약문 ")[1].split("\n")[0])
            if number % 10 == 1:
                raise TimeoutError("no reply")
            if number % 10 == 2:
                return "I would rather not say."
            vote = "A" if (number + len(version)) % 3 else "B"
            note = "+note" if "[정치적 이해관계]" in user else ""
            end = '"}' if number % 10 != 3 else ""
            return f'```json\n{{"vote": "{vote}", "reason": "because {number}{note}{end}\n```'

        return answer

    return factory


@pytest.fixture(scope="module")
def panel(spark):
    values = [tuple(
        f"u{i:031d}" if n == "uuid" else 20 + i % 60 if n == "age"
        else f"요약문 {i}" if n == "persona" else f"{n} {i % 4}" for n in schemas.PERSONA.names)
        for i in range(200)]
    return spark.createDataFrame(values, schemas.PERSONA)


@pytest.fixture(scope="module")
def assets(spark):
    return spark.createDataFrame(
        [(k, v, "{political_context} {{json}}" if k == "system_prompt" else f"context {v}")
         for k in ("system_prompt", "voter_context") for v in ("v2", "v10")],
        schemas.PROMPT_ASSETS)


def test_run_then_rerun_then_cohort(spark, panel, assets, rule, tmp_path):
    folder, base, again = str(tmp_path), ("p/m", "v2"), ("q/n", "v10")
    summary = runs.sample_run(panel, assets, [(*base, 60)], rule, folder, "first", seed=5, tasks=4)
    done = summary.first()
    log = runs.logged(spark, folder)
    dead = runs.failed(spark, folder)
    assert (done.model, done.version, done.attempts) == (*base, 60)
    n_log = log.count()
    assert done.successes == n_log and dead.count() == 60 - done.successes
    assert {r.error.split(":")[0] for r in dead.collect()} == {
        "TimeoutError", "no parseable JSON in response"}
    assert all(r.file_name.startswith("FAIL_2") and r.file_name.endswith("_v2.txt")
               for r in dead.collect())
    docs = runs.documented(spark, folder)
    assert docs.count() == n_log and docs.where("parsed.vote in ('A', 'B')").count() == n_log

    # The same run again neither asks nor doubles anything.
    def stored(run):
        return runs.stored_replies(spark, f"{folder}/replies/{run}")

    replies = {r.persona_uuid: r.elapsed_sec for r in stored("first").collect()}
    runs.sample_run(panel, assets, [(*base, 60)], rule, folder, "first", seed=5)
    log = runs.logged(spark, folder)
    assert log.count() == n_log
    assert replies == {r.persona_uuid: r.elapsed_sec for r in stored("first").collect()}

    # A new run of a larger sample asks only those without an answer.
    runs.sample_run(panel, assets, [(*base, 80)], rule, folder, "second", seed=5)
    asked = stored("second")
    first = runs.logged(spark, folder).where("model = 'p/m'")
    assert first.groupBy("persona_uuid").count().where("count > 1").count() == 0
    assert asked.count() == 80 - done.successes

    # The cohort answers again under another model and version, with notes on some cards.
    log = runs.logged(spark, folder)
    members = {r.persona_uuid for r in log.collect()}
    notes = log.select("persona_uuid").limit(5).withColumn("political_interest", F.lit(" note "))
    runs.cohort_run(spark, assets, base, again, rule, folder, "cohort", notes)
    new = runs.logged(spark, folder).where("model = 'q/n'")
    assert {r.persona_uuid for r in new.collect()} == members
    assert new.where("reason like '%+note%'").count() == 5
    assert new.where("occupation is null or hobbies_and_interests is null").count() == 0

    check_panels(runs.logged(spark, folder), base, again, notes)


def check_panels(log, base, again, notes):
    tables = panels.dashboard(log, facets={"sex": ["sex 1"]}, n_recent=7)
    total = log.count()
    assert tables["kpi"].first().n_rows == total
    for name in ("share_by_model", "share_by_model_version", "by_age", "by_province", "by_sex"):
        assert tables[name].agg(F.sum("count")).first()[0] == total
    assert tables["by_age"].count() == 12
    feed = tables["feed"].collect()
    assert len(feed) == 7 and all(r.sex == "sex 1" and r.color == "#666" for r in feed)
    assert [r.response_file for r in feed] == sorted((r.response_file for r in feed), reverse=True)
    assert tables["raw"].columns == list(panels.RAW_VIEW)

    assert tables["counts"].first().n_rows == total
    assert tables["counts"].first().n_filtered == log.where("sex = 'sex 1'").count()
    assert {r.column for r in tables["options"].collect()} >= {"model", "voter_context_version"}
    assert tables["feed_facets"].count() >= 7 and all("sex 1" in r.profile for r in feed)

    pages = panels.comparison(log, {"v2": base, "v10": again}, notes, ("v2", "v10"))
    kept = panels.comparison(log, {"v2": base, "v10": again}, notes, ("v2", "v10"), "kept",
                             {"sex": ["sex 1", "sex 2"]})
    shown = pages["wide"].where("vote_v2 = vote_v10 and sex in ('sex 1', 'sex 2')").count()
    assert kept["view"].count() == shown
    assert tuple(kept["view_counts"].first()) == (shown, pages["wide"].count())
    n = log.where("model = 'p/m'").count()
    assert tuple(pages["answered"].first()) == (n, n, 5)
    change = pages["change"].first()
    both = pages["wide"].where("vote_v2 <> vote_v10").count()
    assert (change.n_pairs, change.n_changed) == (n, both) and both > 0
    assert pages["transitions"].where("vote_v2 = 'All' and vote_v10 = 'All'").first()["count"] == n
    assert pages["distribution_v10"].agg(F.sum("pct")).first()[0] == pytest.approx(100)
    assert {r.column for r in pages["options"].collect()} == {
        "vote_v2", "vote_v10", "province", "sex"}


def test_one_client_per_setting_and_task(spark):
    made = spark.sparkContext.accumulator(0)

    def factory(model, version):
        made.add(1)
        if model == "bad":
            raise RuntimeError("no key")
        return lambda system, user: f"{model} {version} {system} {user}"

    df = spark.createDataFrame(
        [(i, m, "v", "s", f"u{i}" if i else None) for i in range(10) for m in ("a", "b", "bad")],
        "i int, model string, version string, system_text string, user_text string").coalesce(1)
    got = {(r.i, r.model): r for r in call_model(df, factory).collect()}
    assert made.value == 2 + 9
    assert got[3, "a"].raw_response == "a v s u3" and got[3, "a"].error is None
    assert got[3, "bad"].error == "RuntimeError: no key" and got[3, "bad"].raw_response is None
    assert got[0, "a"].error == "ValueError: prompt could not be filled"
    assert smoke_call(df, factory).count() == 1


def test_unknown_version_goes_to_the_dead_letters(spark, panel, assets, rule, tmp_path):
    summary = runs.sample_run(panel, assets, [("p/m", "v7", 3)], rule, str(tmp_path), "r")
    assert tuple(summary.select("attempts", "successes").first()) == (3, 0)


def test_a_run_goes_on_where_it_failed(spark, panel, assets, tmp_path):
    """Finished replies are kept when a worker dies; the rest, and a grown grid, are asked."""
    calls = tmp_path / "calls"

    def factory(dies):
        def make(model, version):
            def answer(system, user):
                number = int(user.split("요약문 ")[1].split("\n")[0])
                if dies and number % 7 == 3:
                    import os
                    os._exit(1)
                with open(calls, "a") as file:
                    file.write(f"{model} {number}\n")
                return '{"vote": "A", "reason": "r"}'

            return answer

        return make

    cells = [("p/m", "v2", 40)]
    with pytest.raises(Exception):
        runs.sample_run(panel, assets, cells, factory(True), str(tmp_path), "r", tasks=1)
    store = f"{tmp_path}/replies/r"
    kept = {r.persona_uuid for r in runs.stored_replies(spark, store).collect()}
    before = len(calls.read_text().splitlines()) if calls.exists() else 0
    grown = [*cells, ("q/n", "v10", 20)]
    runs.sample_run(panel, assets, grown, factory(False), str(tmp_path), "r", tasks=1)
    log = runs.logged(spark, str(tmp_path))
    assert log.where("model = 'p/m'").count() == 40 and log.where("model = 'q/n'").count() == 20
    after = len(calls.read_text().splitlines()) - before
    assert after == 60 - len(kept) and before - len(kept) <= KEEP_EVERY
    runs.sample_run(panel, assets, grown, factory(True), str(tmp_path), "r", tasks=1)
    assert len(calls.read_text().splitlines()) == before + after


@pytest.mark.parametrize("at_once", [1, 4])
def test_a_worker_that_dies_repeats_a_few_calls(spark, panel, assets, tmp_path, at_once):
    """All but the last few replies of a task are kept, though its bucket was cut off."""
    calls, every = tmp_path / "calls", 5

    def factory(dies):
        def make(model, version):
            def answer(system, user):
                number = int(user.split("요약문 ")[1].split("\n")[0])
                if dies and number == 150:
                    import os
                    os._exit(1)
                with open(calls, "a") as file:
                    file.write(f"{number}\n")
                return '{"vote": "A", "reason": "r"}'

            return answer

        return make

    targets = runs.profile_rows(panel).withColumns({"model": F.lit("m"), "version": F.lit("v2")})
    store = str(tmp_path / "store")

    def asked(dies):
        return runs.ask(targets, factory(dies), store, lambda rows: runs.prompt_rows(rows, assets),
                        tasks=1, calls_at_once=at_once, keep_every=every)

    with pytest.raises(Exception):
        asked(True)
    before = len(calls.read_text().splitlines())
    kept = runs.stored_replies(spark, store).count()
    assert before - kept <= every + at_once and kept < 200
    assert asked(False).count() == 200
    repeated = len(calls.read_text().splitlines()) - 200
    assert repeated <= every + at_once
    assert runs.stored_replies(spark, store).select("persona_uuid").distinct().count() == 200


def test_a_task_that_runs_again_skips_what_it_kept(spark, tmp_path):
    """A second attempt, within the same job or beside it, reads the bucket's kept keys."""
    store = str(tmp_path / "store")
    rows = spark.createDataFrame(
        [(f"u{i}", "m", "v", "s", f"t{i}") for i in range(30)],
        "persona_uuid string, model string, version string, system_text string, user_text string")
    made = spark.sparkContext.accumulator(0)

    def factory(model, version):
        def answer(system, user):
            made.add(1)
            return user
        return answer

    def run():
        return keep_replies(rows, factory, f"{store}/kept", runs.KEYS, buckets=4, keep_every=3)

    first = {r.bucket: (r.asked, r.known) for r in run().collect()}
    assert sum(a for a, _ in first.values()) == 30 and made.value == 30
    again = {r.bucket: (r.asked, r.known) for r in run().collect()}
    assert again == {b: (0, a) for b, (a, _) in first.items()} and made.value == 30
    # The same bucket asked twice side by side: the first reply of a row counts.
    twice = spark.read.parquet(f"{store}/kept").where("persona_uuid < 'u2'").withColumn(
        "timestamp", F.lit("99991231-000000")).withColumn("raw_response", F.lit("late"))
    twice.drop("bucket").write.parquet(f"{store}/kept/bucket=0/late")
    stored = runs.stored_replies(spark, store)
    assert stored.count() == 30 and stored.where("raw_response = 'late'").count() == 0


def test_a_run_shows_all_its_tables_or_none(spark, panel, assets, rule, tmp_path, monkeypatch):
    folder, cells = str(tmp_path), [("p/m", "v2", 40)]
    runs.sample_run(panel, assets, cells, rule, folder, "first", seed=5)
    before = runs.logged(spark, folder)
    n, dead = before.count(), runs.failed(spark, folder).count()

    def stops(*args, **kwargs):
        raise RuntimeError("stopped")

    targets = runs.profile_rows(panel).limit(30).withColumns(
        {"model": F.lit("q/n"), "version": F.lit("v10")})
    replies = runs.ask(targets, rule, f"{folder}/replies/second",
                       lambda rows: runs.prompt_rows(rows, assets))
    for name in ("write_documents", "write_summary"):
        monkeypatch.setattr(runs, name, stops)
        with pytest.raises(RuntimeError):
            runs.record(replies, folder, "second")
        monkeypatch.undo()
        assert runs.logged(spark, folder).count() == n
        assert runs.failed(spark, folder).count() == dead
        assert runs.documented(spark, folder).count() == n
    runs.record(replies, folder, "second")
    log = runs.logged(spark, folder)
    assert log.count() == runs.documented(spark, folder).count() > n
    # Recording a run again replaces its rows in one step; who reads the old ones goes on.
    runs.record(replies, folder, "first")
    assert runs.logged(spark, folder).where("model = 'p/m'").count() == 0 and before.count() == n


def _log_rows(spark, seed, model, version, n):
    """Answers of n personas in one cell, some without an answer, an age or a version."""
    values = [tuple({
        "persona_uuid": f"u{i}", "age": None if i % 9 == 0 else 15 + i % 70, "sex": f"s{i % 2}",
        "province": None if i % 8 == 0 else f"p{i % 4}", "vote": None if i % 7 == 0 else "ABC"[
            (i * seed + len(model)) % 3], "model": model, "elapsed_sec": i / 8 + seed,
        "voter_context_version": version if i % 5 else None, "system_prompt_version": version,
        "response_file": f"2026010{seed}-{i:06}_{model}.json"}.get(name)
        for name in schemas.RESPONSE_LOG.names) for i in range(n)]
    return spark.createDataFrame(values, schemas.RESPONSE_LOG)


def test_kept_panels_equal_the_whole_log(spark, rows, tmp_path):
    """Each refresh reads the new run alone; merged parts give what the whole log gives."""
    folder, base, again = str(tmp_path), ("p/m", "v2"), ("q/n", "v10")
    assert refresh.refresh(spark, folder) == []
    steps = [("a", *base, 60), ("b", *again, 50), ("c", *base, 90), ("a", *again, 70)]
    for k, (run, model, version, n) in enumerate(steps):
        runs.import_log(_log_rows(spark, k + 1, model, version, n), folder, run)
        read = {name.split("/")[0] for name in refresh.refresh(spark, folder, fold_at=2)}
        # The run alone; at its second recording also those that were folded with its first.
        assert read == {run} if k < 3 else run in read
    assert refresh.refresh(spark, folder, fold_at=2) == []
    assert len(published.entries(spark, f"{folder}/panels")) <= 2

    log, parts = runs.logged(spark, folder), refresh.read_parts(spark, folder)
    assert log.count() == 50 + 90 + 70
    for selected in (None, {"model": ["p/m"]}):
        want, got = panels.dashboard(log, selected), refresh.dashboard(parts, selected)
        for name, table in got.items():
            if selected is None or name.startswith("by_"):
                assert rows(table) == rows(want[name].select(*table.columns)), name
    notes = log.select("persona_uuid", F.lit("n").alias("political_interest")).limit(0)
    want = panels.comparison(log, {"v2": base, "v10": again}, notes, ("v2", "v10"))
    got = refresh.comparison(parts, {"v2": base, "v10": again}, ("v2", "v10"))
    for name in ("change", "transitions", "distribution_v2"):
        assert rows(got[name]) == rows(want[name].select(*got[name].columns)), name

    # Two refreshes at one time: a run that both have read counts once.
    again = published.entries(spark, f"{folder}/panels")[0].covers
    refresh._write(refresh.partials(runs.logged(spark, folder, only=again)),
                   f"{folder}/panels", again)
    assert rows(refresh.dashboard(refresh.read_parts(spark, folder))["kpi"]) == rows(
        refresh.dashboard(parts)["kpi"])


def test_latency_leaves_out_making_the_client(spark):
    def factory(model, version):
        import time
        time.sleep(0.5)
        return lambda system, user: "x"

    df = spark.createDataFrame([("a", "v", "s", "u")] * 2,
                               "model string, version string, system_text string, user_text string")
    got = call_model(df.coalesce(1), factory).collect()
    assert all(r.elapsed_sec < 0.3 for r in got)
    assert [r.raw_response for r in call_model(df.coalesce(1), factory, at_once=2).collect()] == [
        "x", "x"]


def test_texts_are_not_shuffled(spark, panel, assets):
    targets = runs.profile_rows(panel).withColumns({"model": F.lit("m"), "version": F.lit("v2")})
    asked = call_model(targets, lambda m, v: None, tasks=4,
                       prepare=lambda rows: runs.prompt_rows(rows, assets))
    lines = asked._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(lines) if "RepartitionByExpression" in x)
    depth = lines[at].index("Repartition")
    below = [x for x in lines[at + 1:] if len(x) - len(x.lstrip(" :+-|")) > depth]
    shuffled = lines[at:at + 2]
    assert below and not any("_text" in x for x in shuffled)
