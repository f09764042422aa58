"""N-gram join, components and top-k against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from panelkit.llm import ngram_join, topk
from panelkit.llm.components import stars

SCHEMA = "doc_id long, text string, cls long, bands string, _k1 int"


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def corpus():
    draw = random.Random(4)
    vocabulary = ["w%d" % i for i in range(3000)]

    def near(words, edits):
        words = list(words)
        for _ in range(edits):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        return words

    texts = []
    for _ in range(40):
        base = draw.choices(vocabulary, k=draw.randrange(60, 200))
        texts.append(base)
        texts += [near(base, draw.randrange(0, 5)) for _ in range(draw.randrange(4))]
    hot = draw.choices(vocabulary, k=150)
    texts += [near(hot, draw.randrange(1, 4)) for _ in range(60)]
    chain = draw.choices(vocabulary, k=100)
    texts += [chain[i:] + draw.choices(vocabulary, k=i) for i in range(0, 40, 4)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, "\t" + " ".join(texts[0]) + "\n") for i in range(30)]
    rows += [(2000, None), (2001, ""), (2002, "\n "), (2003, "a b c"), (2004, "a b  c"),
             (2005, "é " * 40000), (2006, "é " * 40000), (0, " ".join(texts[0])),
             (None, " ".join(texts[5])), (None, "only here x y z")]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_near_copies(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "b", 2) for r in rows], SCHEMA).repartition(3)
    got = ngram_join.near_copies(docs, block=block).collect()
    assert len(got) == len(rows)
    sets = [grams(t) for _, t in rows]
    links = {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
            links[i].add(j)
            links[j].add(i)
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
    group = {}
    for i, r in enumerate(root):
        group.setdefault(r, []).append(rows[i][0])
    wanted = sorted(((rows[i][0], min((d for d in group[root[i]] if d is not None), default=None),
                      len(links[i])) for i in range(len(rows))), key=repr)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=repr) == wanted
    kept = ngram_join.keep_one(docs)
    assert kept.columns == ["doc_id", "text", "cls", "bands"]
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(root)) and set(texts) <= set(rows)
    assert ngram_join.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_banding_reaches_recall():
    for similarity, recall in ((0.8, 0.99999), (0.9, 0.999), (0.5, 0.9)):
        bands, rows = ngram_join.banding(similarity, recall)
        assert bands * rows <= ngram_join.MOST_HASHES
        assert 1 - (1 - similarity ** rows) ** bands >= recall


def test_stars(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(0, 90)] + [(200, i) for i in range(300, 420)] + [
        (draw.randrange(500, 700), draw.randrange(500, 700)) for _ in range(120)] + [(800, 800)]
    got = {r["a"]: r["b"] for r in stars(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {n: n for ab in links for n in ab}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if all(root[a] == root[b] for a, b in links):
            break
    assert got == {n: r for n, r in root.items() if n != r}


def check_top(spark, rows, k=10):
    schema = "vec_id long, embedding array<float>, x string, score int"
    got = {}
    for r in topk.top_k(spark.createDataFrame(
            [(*r, "x", 1) for r in rows], schema).repartition(3), k=k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(v, [int(np.floor(1024 * float(np.float32(c)))) for c in x]) for v, x in rows
            if v is not None and x is not None
            and all(c is not None and np.isfinite(c) for c in x)]
    wanted = {}
    for i, (v, x) in enumerate(good):
        if v % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y)), w)
                           for j, (w, y) in enumerate(good) if j != i)[:k]
            wanted.setdefault(v, []).extend(
                (n + 1, w, -s) for n, (s, w) in enumerate(found))
    assert {q: sorted(r) for q, r in got.items()} == {
        q: sorted(r) for q, r in wanted.items() if r}


def test_top_k(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=16).astype("f4").tolist()) for i in range(900)]
    rows += [(1000 + i, rows[200][1]) for i in range(40)]
    rows += [(None, rows[0][1]), (1200, None), (1300, [float("nan")] * 16),
             (1400, [None, *rows[0][1][1:]]), (1500, [float("inf")] * 16), (1600, []),
             (1700, [0.0] * 16), (300, rows[301][1]), (1800, rows[3][1][:5]), (1900, [-1e-9] * 16)]
    check_top(spark, rows)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 100)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    check_top(spark, rows)
    check_top(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])])
    check_top(spark, [(0, [1.0])])
    check_top(spark, [(1, [1.0]), (2, [1.0])])
    check_top(spark, [(100 * i, [0.0, 0.0]) for i in range(30)])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty).count() == 0


def test_bounds_spare_work(spark):
    """On clustered vectors most candidates are never evaluated, and the result is exact."""
    draw = np.random.default_rng(0)
    centres = draw.normal(size=(8, 16)) * 4
    x = (centres[draw.integers(0, 8, 6000)] + draw.normal(size=(6000, 16)) * 0.1)
    rows = np.floor(x * 1024)
    largest = float((rows ** 2).sum(1).max())
    sample = spark.createDataFrame(
        [(i, i, r.astype(int).tolist()) for i, r in enumerate(rows)],
        "_row long, vec_id long, x array<bigint>")
    pivots = topk.choose_pivots(sample, 16)
    table = topk.pivot_table(sample, pivots, largest).toArrow()
    q = table.slice(0, 20)
    bound = np.abs(np.stack(table["candidate"].to_numpy(zero_copy_only=False))[None]
                   - np.stack(q["query"].to_numpy(zero_copy_only=False))[:, None]).max(2)
    norms = (rows[:20] ** 2).sum(1)
    upper = (norms[:, None] + largest - bound ** 2) / 2
    exact = rows[:20] @ rows.T
    assert (upper * (1 + 1e-9) + 1 >= exact).all()
    tenth = np.sort(exact, axis=1)[:, -11]
    assert (upper >= tenth[:, None]).mean() < 0.5
