"""The pipeline's stages one by one, and the entry's registration."""

from collections import Counter

import corpus_pipeline
from panelkit.llm import mixing, ngram_join, quality, queries
from panelkit.llm.common import cut

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    good = cut(stages["quality rules"](spark, docs, FOLDER), "test-stage")
    kept = {r[0] for r in quality.judge(docs).where("kept").select("doc_id").collect()}
    assert good.columns == COLUMNS and {r[0] for r in rows(good)} == kept
    assert rows(good) <= rows(docs)
    lined = cut(stages["line dedup"](spark, good, FOLDER), "test-stage")
    assert lined.columns == COLUMNS and lined.count() == good.count()
    assert all(r["n_chars"] == len(r["text"]) for r in lined.collect())
    single = cut(stages["n-gram Jaccard join"](spark, lined, FOLDER), "test-stage")
    groups = ngram_join.near_copies(lined).select("class_id").distinct().count()
    assert single.columns == COLUMNS and single.count() == groups
    assert rows(single) <= rows(lined)
    mixed = cut(stages["mixing sources to target weights"](spark, single, FOLDER), "test-stage")
    assert mixed.columns == COLUMNS
    sizes = cut(mixing.sized(single), "test-sizes")
    taken = mixing.apply_mix(sizes, mixing.plan_mix(sizes)).agg({"taken": "sum"}).first()[0]
    assert sum(len(r["text"].split()) for r in mixed.collect()) == taken
    packed = stages["best-fit packing"](spark, mixed, FOLDER).collect()
    assert sum(r["piece"] == 0 for r in packed) == mixed.count()


def test_run_on_hard_rows(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    data = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text + " more", "en", None, 1),
            (2, None, None, None, None), (3, "", "en", "a", 0), (4, text.upper(), "en", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = spark.createDataFrame(data, schema)
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    # Columns under the names that the stages use inside are left out.
    extra = plain.selectExpr("*", *[f"7 AS {n}" for n in (
        "size", "_text", "_d", "_key", "kept", "n_left", "shard", "pos", "words", "h1", "_row")])
    extra.write.parquet(f"{tmp_path}/more/documents.parquet")
    again = corpus_pipeline.run(spark, f"{tmp_path}/more")
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, out.collect()))
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(
        f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_registers_all():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(queries.SQL) <= set(entry.oracle_sql())
