"""Periodic runs against plain definitions."""

import hashlib
import random
import re
import zlib

from panelkit.llm import queries
from panelkit.llm.common import cut
from panelkit.llm.periodic import find_runs, lyndon_lengths, periodic_runs

SCHEMA = "doc_id long, text string, key long, runs string, n_words int, collapsed string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lyndon(s):
    n = len(s)
    return [next((j for j in range(i + 1, n) if s[j:] < s[i:]), n) - i for i in range(n)]


def plain_runs(s, least_length=6, least_exponent=4):
    """Every stretch that no neighbour extends, tried at every start and period."""
    out = []
    for start in range(len(s)):
        for q in range(1, len(s) - start):
            if start and s[start - 1] == s[start - 1 + q]:
                continue
            end = start + q
            while end < len(s) and s[end] == s[end - q]:
                end += 1
            length = end - start
            if length >= max(least_length, least_exponent * q) and not any(
                    all(s[k] == s[k + d] for k in range(start, end - d)) for d in range(1, q)):
                out.append((start, length, q))
    return out


def drawn(random_, most=30):
    s = [random_.randrange(random_.choice([1, 2, 2, 3, 5])) for _ in range(random_.randint(0, most))]
    if s and random_.random() < 0.6:
        a = random_.randrange(len(s))
        s[a:a] = s[:random_.randint(1, 5)] * random_.randint(2, 7)
    return s


def test_lyndon_lengths_and_runs():
    random_ = random.Random(5)
    for _ in range(1500):
        s = drawn(random_)
        ranks = [sorted(set(s)).index(x) for x in s]
        assert lyndon_lengths(ranks) == plain_lyndon(s)
        for limits in ((2, 2), (6, 4), (3, 3), (4, 2.5)):
            assert find_runs(s, *limits) == plain_runs(s, *limits)


def test_long_texts_take_linear_work():
    assert find_runs(["a"] * 200_000) == [(0, 200_000, 1)]
    block = [str(k) for k in range(1000)]
    assert find_runs(["x", *block * 100, "y"]) == [(1, 100_000, 1000)]
    fibonacci, before = "ab", "a"
    while len(fibonacci) < 30_000:
        fibonacci, before = fibonacci + before, fibonacci
    assert find_runs(list(fibonacci)) == []


def test_hard_rows(spark):
    texts = [None, "", " \n\t ", "a a a a a a", "a\x1ca a b " * 5, "x y " * 3, "x y " * 4,
             "\x00 é " * 9, "w " * 100_000, "a a a a a a"]
    docs = cut(spark.createDataFrame([(k if k else None, t, 1, "r", 2, "c")
                                      for k, t in enumerate(texts)], SCHEMA), "docs")
    got = periodic_runs(docs).collect()
    assert len(got) == len(texts)
    by_key = {r.key: r for r in got}
    for k, text in enumerate(texts):
        words = WORD.findall(text or "")
        r = by_key[k if k else None]
        assert r.n_words == len(words)
        if len(words) < 1000:
            assert [tuple(x) for x in r.runs] == plain_runs(words)
    assert by_key[8].collapsed == "w" and by_key[6].collapsed == "x y"
    assert by_key[5].collapsed == "x y x y x y"
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def expected(doc_id, text):
    words = WORD.findall(text or "")
    h, n = (zlib.crc32(str(doc_id).encode()), len(words)) if doc_id is not None else (1, 0)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    elif doc_id is None:
        words = WORD.findall(text or "")
    runs = plain_runs(words) if len(words) < 120 else find_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3),
            1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query(spark, tmp_path):
    random_ = random.Random(9)
    data = [(k, " ".join(f"w{random_.randrange(9)}" for _ in range(random_.randrange(100))))
            for k in range(300)] + [(None, "a " * 9), (7, None), (23, ""), (301, "b " * 5000)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((expected(*d) for d in data), key=repr)
    assert any(r[1] for r in got)
