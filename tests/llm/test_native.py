"""Line dedup, quality rules, mixing and sharding against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelkit.llm import line_dedup, mixing, quality, sharding
from panelkit.llm.common import cut

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size long, shard int, pos int, line string, words string, kept int, _text string")
LONG = "This line is long enough to count."
SPACES = " \t\n\x0b\x0c\r"


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None, 7, 7, 7, "x", "x", 7, "x")


TEXTS = [
    row(1, f"{LONG}\nown one two three"), row(2, f"  {LONG.upper()}\t\nmore"),
    row(3, f"own\n{LONG}\n{LONG}"), row(4, None), row(5, ""), row(6, "\n\n"),
    row(7, "short\nshort\nshort"), row(7, "short\nshort\nshort"), row(None, f"{LONG}\nz"),
    row(None, None), row(8, "é" * 19 + "\n" + "É" * 20, None), row(9, "É" * 20, None),
    row(10, "É" * 20 + " ", None), row(11, "word " * 5000 + LONG, "b"),
    row(12, "a b c d e f g h i a b c d e f g h", "b"),
    row(13, " ".join(f"w{i}" for i in range(25)) + " # < | x\n\ny\ny", "b"),
]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return cut(spark.createDataFrame(TEXTS, SCHEMA).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(line):
    line = line.strip(SPACES)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def test_lines(docs, empty):
    holders = defaultdict(set)
    for doc_id, text, *_ in TEXTS:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc_id)
    wanted = []
    for doc_id, text, *_ in TEXTS:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            ids = holders[key(line)]
            shared = len(key(line)) >= 20 and len(ids) >= 3
            if not shared or doc_id == max(i for i in ids if i is not None):
                kept.append(line)
        wanted.append((doc_id, len(lines), len(lines) - len(kept),
                       hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    out = line_dedup.dedup_lines(docs)
    assert {"lang", "shard", "pos", "line"} <= set(out.columns)
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_quality_counts(docs, empty):
    out = quality.judge(docs)
    got = [tuple(r) for r in out.select("doc_id", *quality.FEATURES, "base_failed").collect()]
    wanted = []
    for doc_id, text, *_ in TEXTS:
        words = words_of(text)
        grams = defaultdict(list)
        for i in range(len(words) - 7):
            grams[tuple(words[i:i + 8])].append(i)
        covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)}
        rows = [x for x in (text or "").split("\n") if words_of(x)]
        wanted.append((
            doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(rows) - len(set(rows)), len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words)))
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert quality.judge(empty).count() == 0


def test_boilerplate_depletes_but_copies_do_not(spark):
    def text(i):
        return "\n".join(" ".join(f"w{i}-{k}-{j}" for j in range(12)) for k in range(4))

    footer = " ".join(f"legal{j}" for j in range(45))
    rows = [(i, f"{text(i)}\n{footer}", "h") for i in range(30)]
    rows += [(100 + i, f"{footer}\ntiny page {i}", "h") for i in range(3)]
    rows += [(200 + i, text(999), "h") for i in range(30)]
    rows += [(300, f"{footer}\ntiny page", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r[0]: r[1] for r in quality.judge(docs).select("doc_id", "kept").collect()}
    assert all(kept[i] for i in range(30)), "clean pages with a footer stay"
    assert not any(kept[100 + i] for i in range(3)), "pages of little but footer go"
    assert all(kept[200 + i] for i in range(30)), "copies are left to deduplication"
    assert kept[300], "frequent on another host only"


def test_frequent_lines_count_documents_whatever_their_hash(spark):
    def digest(line):
        return hashlib.md5(line.encode()).hexdigest()

    lines = sorted((f"this line number {i} is on many pages of the host" for i in range(500)),
                   key=digest)
    least, template = lines[0], "\n".join(lines[1:21])
    own = "\n".join(["own {0} word{0}a word{0}b word{0}c word{0}d"] * 2)
    rows = [(i, f"{least}\n{own.format(i)}", "least") for i in range(11)]
    rows += [(100 + i, f"{template}\npage {i}", "template") for i in range(11)]
    rows += [(200 + i, f"{least}\n{own.format(i)}", "few") for i in range(10)]
    rows += [(300 + i, template, "copies") for i in range(11)]
    assert all(digest(least) < digest(own.format(i).split("\n")[0]) for i in range(11))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r[0]: r[1:] for r in quality.judge(docs).select(
        "doc_id", "n_left", "n_words", "base_failed", "kept").collect()}
    n = len(least.split())
    assert all(got[i][1] - got[i][0] == n for i in range(11)), "more than ten hold the line"
    assert all(got[100 + i][0] == 2 and not got[100 + i][3] for i in range(11)), "template only"
    assert all(got[200 + i][0] == got[200 + i][1] for i in range(10)), "ten hold the line"
    assert all(got[300 + i][0] == got[300 + i][1] for i in range(11)), "exact copies count once"


def test_frequent_lines_are_removed_by_position(spark):
    legal = "  All RIGHTS of this host are reserved "
    rows = [(i, f"{legal}\nown {i}\n\n{legal.lower()}\nown {i}", "h", 7) for i in range(11)]
    rows += [rows[0], (20, f"{legal}\nx", "other", 7), (21, None, "h", 7), (22, "", None, 7),
             (23, legal, "h", 7), (None, f"a\n{legal}", "h", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    out = quality.without_frequent(docs.repartition(3))
    assert out.columns == docs.columns
    wanted = [(i, "\n".join(x for x in text.split("\n") if len(x) < 20), s, n)
              if s == "h" and text else (i, text, s, n) for i, text, s, n in rows]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(wanted, key=repr)
    assert quality.without_frequent(docs.limit(0)).count() == 0


def check_mix(rows, docs):
    """Targets by repeated sharing, as the words of the rule say it."""
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words_of(r[1]))
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            goal |= {s: level * weight[s] for s in open_}
            break
        goal |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    sizes = cut(mixing.sized(docs), "test-sizes")
    plan = mixing.plan_mix(sizes)
    got = mixing.apply_mix(sizes, plan).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert all(0 <= d["shard"] < 8 for d in r["draws"])
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - goal[s]) <= 3, (s, taken[s], goal[s])
    again = mixing.apply_mix(sizes, mixing.plan_mix(sizes)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    return plan


def test_mix(docs, empty, spark):
    plan = check_mix(TEXTS, docs)
    mixed = mixing.mixed_rows(docs, plan)
    assert sum(len(words_of(r["text"])) for r in mixed.collect()) == sum(
        r["taken"] for r in mixing.apply_mix(mixing.sized(docs), plan).collect())
    assert {"lang", "words", "_shard", "_order"} <= set(mixed.columns)
    assert mixing.apply_mix(mixing.sized(empty), mixing.plan_mix(mixing.sized(empty))).count() == 0
    rows = [row(i, "w " * (i % 40), ("hot", "a", "b", "hot", None)[i % 5]) for i in range(3000)]
    check_mix(rows, spark.createDataFrame(rows, SCHEMA))


def test_splitting_tree(spark):
    sources = spark.createDataFrame([("a", 70), ("b", 9), ("c", 0), (None, 21)],
                                    "source string, quota long")
    got = {r["source"]: r["starts"] for r in mixing.split_quotas(sources, 5).collect()}
    assert got["c"] is None
    for name, quota in (("a", 70), ("b", 9), (None, 21)):
        runs = [*got[name], quota]
        assert runs[0] == 0 and runs == sorted(runs)
    per_shard = [sum(([*got[n], q][k + 1] - got[n][k]) for n, q in (
        ("a", 70), ("b", 9), (None, 21))) for k in range(5)]
    assert per_shard == [20] * 5


@pytest.mark.parametrize("rows_per_range", [100_000, 4])
def test_shards(docs, empty, rows_per_range):
    got = sharding.assign_shards(sharding.record_sizes(docs), fan_out=4, samples=32,
                                 range_rows=rows_per_range).collect()
    size = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()))
            for r in TEXTS]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(
        size, key=repr)
    total, before = sum(s for _, s, _ in size), 0
    got.sort(key=lambda r: (r["shard"], r["slot"]))
    ids = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert ids == sorted(ids)
    slots = defaultdict(int)
    for r in got:
        assert r["shard"] == 8 * before // total and r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
        before += r["size"]
    assert sharding.assign_shards(sharding.record_sizes(empty)).count() == 0


def test_sharded_rows(docs):
    out = sharding.shard_rows(docs)
    assert out.count() == len(TEXTS) and "lang" in out.columns
    assert out.groupBy("shard", "slot").count().where("count > 1").count() == 0
