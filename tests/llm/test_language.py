"""Language: held-out accuracy, defined results, and the model's parts."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from panelkit.llm import language, queries

SCHEMA = "doc_id long, text string, lang string, score string, bits int"


def rows():
    draw = random.Random(2)
    syllables = {"aa": ["ka", "lo", "mi", "ta", "re"], "bb": ["sch", "ein", "und", "ver", "lich"],
                 "cc": ["è", "eau", "ou", "tion", "ê"]}
    out = []
    for i in range(450):
        lang = ("aa", "bb", "cc")[i % 3]
        text = " ".join("".join(draw.choices(syllables[lang], k=draw.randrange(1, 4)))
                        for _ in range(draw.randrange(3, 60)))
        out.append((i, text, lang if i % 7 else None, "s", 1))
    return out


def test_held_out(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    model = language.learn(docs, F.col("doc_id") % 2 == 0, per_language=40)
    assert model.languages == ["aa", "bb", "cc"]
    extra = [(900, None, "aa", "s", 1), (901, "", "aa", "s", 1), (902, "12 -- !", "bb", "s", 1),
             (None, "schein und verlich", None, "s", 1), (903, "ka lo " * 50000, None, "s", 1)]
    got = language.predict(docs.unionByName(spark.createDataFrame(extra, SCHEMA)), model).collect()
    assert len(got) == len(data) + 5
    by_id = {r["doc_id"]: r for r in got}
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 450 and r["doc_id"] % 2]
    right = sum(r["lang_pred"] == ("aa", "bb", "cc")[r["doc_id"] % 3] for r in held)
    assert right >= 0.99 * len(held)
    for i in (900, 901, 902):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[None]["lang_pred"] == "bb" and by_id[903]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s", 1)], SCHEMA)
    assert language.learn(docs, F.lit(True)) is None
    assert language.predict(docs, None).first()["lang_pred"] == "und"
    empty = spark.createDataFrame([], SCHEMA)
    assert language.predict(empty, None).count() == 0


def test_one_language(spark):
    docs = spark.createDataFrame([(1, "abc", "xx", "s", 1)], SCHEMA)
    model = language.learn(docs, F.lit(True))
    assert language.predict(docs, model).first()["lang_pred"] == "xx"


def test_kernel_is_cosine_of_sets():
    a, b = "abc abd", "xabc"
    sets = []
    for text in (a, b):
        points = re.sub(r"[^a-z]+", " ", text)
        sets.append({points[i:i + n] for n in range(1, 5) for i in range(len(points) - n + 1)})
    one, two = language.presence([a, b])
    assert one.sum() == len(sets[0]) and two.sum() == len(sets[1])
    assert np.dot(one, two) == len(sets[0] & sets[1])


def exact_grams(text):
    """Distinct 1- to 4-grams of the lower-cased text, runs of other characters as one space."""
    out, before = [], False
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif before:
            out.append(" ")
        before = c.isalpha()
    s = "".join(out)
    return {s[i:i + n] for n in range(1, 5) for i in range(len(s) - n + 1)}


def exact_scores(train, langs, texts, ridge):
    """One-versus-rest kernel ridge on the exact sets: no hashing, no landmarks."""
    def kernel(xs, ys):
        return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in ys] for x in xs])

    sets = [exact_grams(t) for t in train]
    wanted = np.array([[1.0 if a == b else -1.0 for b in sorted(set(langs))] for a in langs])
    alpha = np.linalg.solve(kernel(sets, sets) + ridge * np.eye(len(sets)), wanted)
    return kernel([exact_grams(t) for t in texts], sets) @ alpha


def test_scores_are_those_of_exact_kernel_ridge():
    """With every training row as a landmark the model is plain ridge, but for hash collisions."""
    data = [(t, lang or "aa") for _, t, lang, *_ in rows() if lang][:150]
    train, rest = data[:90], data[90:]
    texts, langs = [t for t, _ in train], [lang for _, lang in train]
    model = language.fit(language.presence(texts), langs, landmarks=len(train))
    asked = [t for t, _ in rest]
    got = model.scores(language.presence(asked))
    want = exact_scores(texts, langs, asked, language.RIDGE)
    assert np.abs(got - want).max() < 0.05
    assert (got.argmax(1) == want.argmax(1)).all()
    # Fewer landmarks lose little.
    fewer = language.fit(language.presence(texts), langs, landmarks=24)
    assert (fewer.scores(language.presence(asked)).argmax(1) == want.argmax(1)).mean() > 0.97


def test_equal_scores_go_to_the_first_language(spark):
    docs = spark.createDataFrame(
        [(k, "same words here", lang, "s", 1) for k, lang in enumerate(["yy", "xx"] * 4)], SCHEMA)
    model = language.learn(docs, F.lit(True))
    got = language.predict(docs, model).select("lang_pred").distinct().collect()
    assert [r["lang_pred"] for r in got] == ["xx"]


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.op8_language_id(spark, folder).join(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out AND lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
