import csv
import json

import pandas as pd
import pytest
from pyspark.sql import types as T

from panelkit import schemas
from panelkit.functions.columns import log_order
from panelkit.operators import compare, numbering
from panelkit.operators.numbering import chunk_rows
from panelkit.sources import readers, sinks


def log_row(i, **values):
    row = {n: f"{n} {i}" for n in schemas.RESPONSE_LOG.names}
    row |= {"age": 20 + i, "elapsed_sec": i / 8, "model": "p/m:1", "voter_context_version": "v2"}
    return row | values


def frame(spark, rows):
    return spark.createDataFrame(
        [tuple(r[n] for n in schemas.RESPONSE_LOG.names) for r in rows], schemas.RESPONSE_LOG)


ROWS = [
    log_row(0, reason='He said "yes", twice\nand left'), log_row(1, reason="한글, 쉼표"),
    log_row(2, voter_context_version=None, system_prompt_version=None), log_row(3, model="q/n")]


def test_log_csv(spark, tmp_path):
    path = tmp_path / "log.csv"
    pdf = pd.DataFrame(ROWS)
    pdf.head(2).to_csv(path, index=False, encoding="utf-8-sig")
    for i in (2, 3):
        pdf.iloc[i:i + 1].to_csv(path, mode="a", header=False, index=False, encoding="utf-8-sig")
    got = readers.read_log_csv(spark, str(path))
    assert got.schema == schemas.RESPONSE_LOG
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        map(tuple, frame(spark, ROWS).collect()), key=repr)


def test_interest_tsv(spark, tmp_path):
    path = tmp_path / "notes.tsv"
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, delimiter="\t")
        out.writerow(["persona_uuid", "sex", "political_interest"])
        out.writerow(["a", "x", 'two\nlines, "quoted"\tand a tab'])
        out.writerow(["b", "y", ""])
    schema = T.StructType([T.StructField(n, T.StringType())
                           for n in ("persona_uuid", "sex", "political_interest")])
    got = readers.read_interests(spark, str(path), schema)
    assert sorted(map(tuple, got.collect())) == [
        ("a", 'two\nlines, "quoted"\tand a tab'), ("b", None)]


def test_log_append_is_idempotent_per_run(spark, tmp_path):
    path, df = str(tmp_path / "log"), frame(spark, ROWS)
    sinks.append_log(df.limit(3), path, "one")
    sinks.append_log(df.limit(3), path, "one")
    sinks.append_log(df.where("age = 23"), path, "two")
    got = readers.read_log(spark, path)
    assert got.columns == schemas.RESPONSE_LOG.names
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        map(tuple, df.collect()), key=repr)
    wide = compare.wide_compare(got, {"a": ("q/n", "v2")}, log_order(), values=("vote",))
    scan = wide._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1]
    assert "(model" in scan.split("PushedFilters")[0] and "= q/n)" in scan.split("PushedFilters")[0]
    plan = got.where("model = 'q/n'").select("vote")._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(model" in plan.toString()


def document(i, **more):
    row = log_row(i)
    persona = {n: row[n] for n in (*schemas.DEMOGRAPHICS, "persona_summary")}
    return {"timestamp": "20260428-142501", "model": "m", "persona_uuid": f"u{i}",
            "elapsed_sec": 1.5, "persona": persona, "raw_response": '{"vote": "A"}',
            "parsed": {"vote": "A", "reason": "b"}} | more


def test_document_layouts(spark, tmp_path):
    versions = {"voter_context_version": "v2", "system_prompt_version": "v2"}
    layouts = [document(0), document(1, **versions),
               document(2, **versions, political_interest="x"),
               document(3, **versions, political_interest=float("nan"))]
    for i, d in enumerate(layouts):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, ensure_ascii=False, indent=2))
    docs = readers.read_documents(spark, str(tmp_path / "*.json"))
    got = {r.persona_uuid: r for r in readers.document_log(docs).collect()}
    assert [got[f"u{i}"].political_interest for i in range(4)] == [None, None, "x", None]
    assert [got[f"u{i}"].voter_context_version for i in range(4)] == [None, "v2", "v2", "v2"]
    assert got["u0"].vote == "A" and got["u3"].age == 23 and got["u1"].response_file == "1.json"


def test_document_round_trip(spark, tmp_path, rows):
    df = frame(spark, ROWS).withColumnRenamed("response_file", "timestamp")
    sinks.write_documents(df, str(tmp_path / "docs"), "r")
    stored = readers.read_document_lines(spark, str(tmp_path / "docs"))
    got = readers.document_log(stored.selectExpr("*", "timestamp AS response_file"))
    names = ["persona_uuid", *schemas.DEMOGRAPHICS, "persona_summary", "vote", "reason", "model",
             "elapsed_sec", "voter_context_version", "timestamp"]
    assert rows(got.select(*names)) == rows(df.select(*names))


def test_failures(spark, tmp_path, rows):
    (tmp_path / "FAIL_20260429-150848_p_m-1_d8cdd6b3_v5.txt").write_text(
        "=== ERROR: no JSON: 'x'\n=== MODEL: p/m-1\n=== UUID: d8cdd6b3aa\n\n{\n\n=== UUID: no")
    (tmp_path / "FAIL_20260428-142627_m_1_59823014.txt").write_text(
        "=== ERROR: e\n=== MODEL: m:1\n=== UUID: 59823014aa\n\n")
    got = readers.read_failures(spark, str(tmp_path / "FAIL_*.txt")).drop("file_name")
    assert rows(got) == sorted([
        ("no JSON: 'x'", "p/m-1", "d8cdd6b3aa", "{\n\n=== UUID: no", "m-1", "20260429-150848", "v5"),
        ("e", "m:1", "59823014aa", "", "m:1", "20260428-142627", None)], key=repr)


def test_assets_and_notes(spark, tmp_path, rows):
    for name in ("voter_context_v2.md", "system_prompt_v10.md", "notes.md", "voter_context_vx.md"):
        (tmp_path / name).write_text(f"text of\n{name}")
    assert rows(readers.read_assets(spark, str(tmp_path))) == [
        ("system_prompt", "v10", "text of\nsystem_prompt_v10.md"),
        ("voter_context", "v2", "text of\nvoter_context_v2.md")]
    folder = tmp_path / "_012_results"
    folder.mkdir()
    (folder / "3.txt").write_text("a\nb")
    assert rows(readers.read_notes(spark, str(folder))) == [(12, 3, "a\nb")]


def test_chunk_files(spark, tmp_path):
    people = spark.range(25).selectExpr("cast(id AS string) AS persona_uuid", "cast(NULL AS int) AS age")
    chunked = chunk_rows(people, ["persona_uuid"])
    sinks.write_chunks(chunked, str(tmp_path / "json"))
    files = sorted((tmp_path / "json").glob("chunk_folder=*/*.json"))
    assert len(files) == 3
    first = [json.loads(line) for line in files[0].read_text().splitlines()]
    assert [r["idx"] for r in first] == list(range(10)) and first[0]["age"] is None
    sinks.write_chunks(chunked, str(tmp_path / "csv"), "csv", chunks_per_folder=2)
    assert len(list((tmp_path / "csv").glob("chunk_folder=*/*.csv"))) == 2


def test_chunks_write_keys_only(spark, monkeypatch):
    """Numbers are found on the keys; whole rows are neither sorted nor written for them."""
    written = []
    real = numbering.number_rows
    monkeypatch.setattr(numbering, "number_rows",
                        lambda df, order, name: written.append(df.columns) or real(df, order, name))
    people = spark.range(95).selectExpr("cast(id AS string) AS k", "id", "repeat('x', 500) AS text")
    got = chunk_rows(people, ["k"]).collect()
    assert written == [["k"]] and len(got) == 95
    for place, r in enumerate(sorted(got, key=lambda r: r.k)):
        assert (r.chunk_id, r.idx, len(r.text)) == (place // 10 + 1, place % 10, 500)


def opened(df):
    """Files that the scan of a collected frame has opened."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numFiles").value()


def test_files_are_chosen_by_name_unopened(spark, tmp_path, rows):
    folder = tmp_path / "replies"
    folder.mkdir()
    every = []
    for i in range(2000):
        model, version = ("p_m", "q_n")[i % 2], f"v{i % 5}"
        stamp = f"202601{1 + i % 28:02}-{i:06}"
        name = f"{stamp}_{model}_{i:08}_{version}_{version}.json"
        (folder / name).write_text(json.dumps({"persona_uuid": f"{i:08}", "model": model}))
        every.append((f"{i:08}", model, version, stamp))
    (folder / "notes.json").write_text("{}")
    letters = tmp_path / "letters"
    letters.mkdir()
    (letters / "FAIL_20260101-000000_p_m_00000000_v1.txt").write_text(
        "=== ERROR: e\n=== MODEL: p/m\n=== UUID: 00000000\n\ntext")

    def read(**names):
        return readers.read_documents(
            spark, str(folder), readers.named_files(**names)).select("persona_uuid")

    for names, test in (
            ({"models": ["p/m"], "versions": ["v3"]}, lambda r: r[1] == "p_m" and r[2] == "v3"),
            ({"personas": ["00000007-and-more"]}, lambda r: r[0] == "00000007"),
            ({"since": "20260110-", "until": "20260112-"},
             lambda r: "20260110-" <= r[3] < "20260112-"),
            ({"models": []}, lambda r: False)):
        want = sorted((r[0],) for r in every if test(r))
        assert rows(read(**names)) == want
        if want:
            assert opened(read(**names)) == len(want)
    # Small files share tasks.
    assert readers.read_documents(spark, str(folder)).rdd.getNumPartitions() < 200
    assert readers.read_failures(
        spark, str(letters), readers.named_files(versions=["v1"], models=["p/m"])).where(
        "error = 'e'").count() == 1


def test_snapshot_replaces(spark, tmp_path):
    path, df = str(tmp_path / "snap"), frame(spark, ROWS)
    sinks.write_snapshot(df, path)
    sinks.write_snapshot(df.limit(1), path)
    assert readers.read_log_csv(spark, path).collect() == df.limit(1).collect()


def test_missing_input(spark, tmp_path):
    empty = readers.read_or_empty(spark, str(tmp_path / "none"), schemas.INTERESTS)
    assert empty.count() == 0 and empty.schema == schemas.INTERESTS
    (tmp_path / "bad.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        readers.read_or_empty(spark, str(tmp_path / "bad.parquet"), schemas.INTERESTS).count()


def test_personas_are_pruned(spark, tmp_path):
    path = str(tmp_path / "panel")
    spark.createDataFrame([("u", 30)], "uuid string, age int").write.parquet(path)
    df = readers.read_personas(spark, path)
    assert readers.peek(df).first().age == 30 and df.first().persona is None
    plan = df.select("uuid")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<uuid:string>" in plan
