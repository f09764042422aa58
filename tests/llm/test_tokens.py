"""Token ids, token files and packing against the tokenizers library and bounds."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelkit.llm import packing, range_coder, token_files, tokens
from panelkit.llm.tokens import Encoder
from panelkit.runtime import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_tokens long, start long, _row long, shard int"
TEXTS = [(3, "Two words.", 1, 1, 1, 1), (1, None, 1, 1, 1, 1), (2, "", 1, 1, 1, 1),
         (None, "no id", 1, 1, 1, 1), (7, "again", 1, 1, 1, 1), (7, "again", 1, 1, 1, 1),
         (9, "long text, " * 9000, 1, 1, 1, 1), (8, "É́a  x y 'S don't ...,.", 1, 1, 1, 1)]


@pytest.fixture(scope="module")
def tool():
    return Encoder(PATH)


def ids_of(tool, text, end):
    return np.array([*tool.tool.encode(text or "", add_special_tokens=False).ids, end], "<u4")


MARKED = st.lists(st.sampled_from([
    "<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|", "|>", " ", "a", "B.", "É", "\n"]),
    max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=("Cs",))) | MARKED,
                max_size=5))
def test_ids_of_any_text(texts):
    tool = test_ids_of_any_text.tool = getattr(test_ids_of_any_text, "tool", None) or Encoder(PATH)
    ids, lengths = tool.encode(texts)
    each = [tool.tool.encode(t, add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(e) for e in each]
    assert ids.tolist() == [i for e in each for i in e]


def test_ids_of_hard_texts(tool):
    texts = ["It's they'RE word. word, a.b. x.\ny,", "H̱ ẖ ̱", "İstanbul ΣΑΣ ΑΣ.",
             "<|startoftext|> <|endoftext|>x", "a b\x85c　d\x1ce", "ﬁ Ǆ ß ẞ 1234 ½"]
    ids, _ = tool.encode(texts)
    assert ids.tolist() == [i for t in texts for i in tool.whole(t).tolist()]


@pytest.mark.parametrize("n", [0, 1, 2, 31, 64, 1000, 70_001])
@pytest.mark.parametrize("kind", ["same", "random", "words"])
def test_coder_round_trip(n, kind):
    draw = np.random.default_rng(n)
    ids = {"same": np.full(n, 7), "random": draw.integers(0, 49408, n),
           "words": draw.zipf(1.3, n) % 49408}[kind].astype(np.int64)
    data = range_coder.encode(ids, 49408)
    assert (range_coder.decode(data, n, 49408) == ids).all()
    if n == 70_001 and kind == "same":
        assert len(data) < n / 4


def test_vocabularies_beyond_the_limit_are_refused():
    ids = np.array([5, range_coder.ID_LIMIT - 1, 0])
    data = range_coder.encode(ids, range_coder.ID_LIMIT)
    assert (range_coder.decode(data, 3, range_coder.ID_LIMIT) == ids).all()
    with pytest.raises(ValueError, match="vocabularies"):
        range_coder.encode(ids, range_coder.ID_LIMIT + 1)


def test_files(spark, tool):
    docs = spark.createDataFrame(TEXTS, SCHEMA).repartition(3)
    folder = new_folder(spark, "test-files")
    token_files.write_tokens(docs, PATH, folder, block_ids=50)
    got = token_files.read_tokens(spark, folder, PATH).collect()
    got.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(got) == len(TEXTS)
    start, texts = 0, {d: t for d, t, *_ in TEXTS}
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) // 4
        assert r["ids"] == ids_of(tool, texts[r["doc_id"]], 1).tobytes()
        start += r["n_tokens"]
    nothing = new_folder(spark, "test-files")
    token_files.write_tokens(spark.createDataFrame([], SCHEMA), PATH, nothing)
    assert token_files.read_tokens(spark, nothing, PATH).count() == 0


def test_damage_is_seen(spark):
    folder = new_folder(spark, "test-files")
    token_files.write_tokens(spark.createDataFrame(TEXTS, SCHEMA), PATH, folder)
    broken = new_folder(spark, "test-files")
    spark.read.parquet(folder).selectExpr(
        "shard", "block", "first", "doc_ids", "lengths", "payload", "checksum + 1 AS checksum"
    ).write.parquet(broken)
    with pytest.raises(Exception, match="is damaged"):
        token_files.read_tokens(spark, broken, PATH).collect()


def test_pieces_and_sequences(spark, tool):
    docs = spark.createDataFrame(TEXTS, SCHEMA).repartition(3)
    cuts = packing.pieces(docs, PATH, 64)
    out = packing.pack(cuts.withColumn("lang", cuts.doc_id), 64, partition_rows=40)
    assert "lang" in out.columns
    rows, whole = out.collect(), {}
    texts = {d: t for d, t, *_ in TEXTS}
    for r in rows:
        ids = ids_of(tool, texts[r["doc_id"]], 0)
        part = ids[r["start"]:r["start"] + r["length"]]
        assert r["start"] == 64 * r["piece"] and r["ids_crc32"] == zlib.crc32(part.tobytes())
        assert r["length"] == len(part)
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + len(part)
    assert whole[7] == 2 * len(ids_of(tool, "again", 0))
    assert whole[9] == len(ids_of(tool, texts[9], 0))
    check_sequences(rows, 64)
    assert packing.pack(packing.pieces(spark.createDataFrame([], SCHEMA), PATH)).count() == 0


def check_sequences(rows, capacity):
    runs = {}
    for r in rows:
        runs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for run in runs.values():
        at = 0
        for offset, length in sorted(run):
            assert offset == at
            at += length
        assert at <= capacity
    return len(runs)


def test_exchange_saves_sequences(spark):
    draw = np.random.default_rng(1)
    lengths = [(int(x),) for x in draw.integers(300, 1100, 1500)]
    rows = spark.createDataFrame(lengths, "length long").repartition(4)
    alone = check_sequences(packing.pack(rows, exchanges=0, partition_rows=50).collect(), 2048)
    shared = check_sequences(packing.pack(rows, exchanges=3, partition_rows=50).collect(), 2048)
    assert packing.lower_bound(np.array([x for x, in lengths]), 2048) <= shared <= alone


def test_small_partitions_reach_the_bound_over_all(spark):
    """Each partition ends with a part-filled sequence; together they give what one gives."""
    draw = np.random.default_rng(2)
    lengths = np.minimum(draw.geometric(1 / 300, 6000), 2048)
    rows = spark.createDataFrame([(int(x),) for x in lengths], "length long").repartition(4)
    bound = packing.lower_bound(lengths, 2048)
    assert packing.total_bound(rows, 2048) == bound
    assert check_sequences(packing.pack(rows, partition_rows=10_000).collect(), 2048) == bound
    assert check_sequences(packing.pack(rows, partition_rows=1000).collect(), 2048) == bound
    # Partitions of a few dozen sequences may end one above it.
    assert check_sequences(packing.pack(rows, partition_rows=200).collect(), 2048) <= bound + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_bound_is_below_every_packing(lengths):
    lengths = np.array(lengths, np.int64)

    def fewest(left, free):
        if not left:
            return len(free)
        best = fewest(left[1:], [*free, 20 - left[0]])
        for k in {f: k for k, f in enumerate(free) if f >= left[0]}.values():
            best = min(best, fewest(left[1:], [*free[:k], free[k] - left[0], *free[k + 1:]]))
        return best

    true = fewest(sorted(lengths.tolist(), reverse=True), [])
    assert packing.lower_bound(lengths, 20) <= true
    _, _, used = packing.best_fit_decreasing(lengths, 20)
    assert true <= used


def test_equal_stretches_are_looked_up_once(monkeypatch):
    asked = []

    class Counted(tokens.WordNumbers):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    monkeypatch.setattr(tokens, "WordNumbers", Counted)
    tool = tokens.Encoder(PATH)
    texts = [" Ab\tab \x0bAB cd\x1c", "", "\n", "ab " * 1000]
    ids, lengths = tool.encode(texts)
    want = [tool.whole(t).tolist() for t in texts]
    assert ids.tolist() == sum(want, []) and lengths.tolist() == [len(w) for w in want]
    assert sorted(asked) == [b"", b"ab", b"cd\x1c"]


def test_marks_after_letters_of_any_kind(tool):
    stems = ["a", "é", "ÿ", "×", "÷", "ª", "İ", "ƻ", "ȺÀ", "ɐ", "ɏ", "σΣ", "1", "a1", "'", "it's",
             "…", ""]
    texts = [s + m + end for s in stems for m in [*tokens.MARKS.decode(), "'", "$$'s", "-.'ll"]
             for end in ("", "b", " c")]
    ids, lengths = tool.encode(texts)
    want = [tool.whole(t).tolist() for t in texts]
    assert ids.tolist() == sum(want, []) and lengths.tolist() == [len(w) for w in want]


def test_words_with_marks_and_accents_are_asked_of_the_model(monkeypatch):
    tool = Encoder(PATH)
    tool.encode(["$$$ , ?!"])
    text = "été$$$ onthe, aǆa?! Éelleç"
    want = tool.whole(text).tolist()
    rows, plain = [], tool.row_ids

    def row_ids(row, used):
        rows.append(used)
        return plain(row, used)

    monkeypatch.setattr(tool, "row_ids", row_ids)
    assert tool.encode([text])[0].tolist() == want
    assert rows and all(used is tool.by_space for used in rows)


def test_words_that_came_again_stay_when_memory_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 6)
    tool = Encoder(PATH)
    for text in ("often seen", "often seen once", "one two three often.", "a b c often é,"):
        assert tool.encode([text])[0].tolist() == tool.whole(text).tolist()
    assert b"often" in tool.words and b"once" not in tool.words
    assert len(tool.words) < 12


def test_sums_of_the_coder_carry_as_whole_numbers():
    draw = np.random.default_rng(3)
    added = draw.integers(0, 1 << 40, (200, 5))
    added[draw.random((200, 5)) < 0.3] = (1 << 40) - 1
    moved = draw.integers(0, 3, (200, 5)).astype(np.uint8)
    moved[:2, 0] = 1
    added[2:, 0] = 0
    added[:3, 0] = 0x00FF_FFFF_FFFF, 0xFFFF_FFFF, 0x1_0000
    used, words = range_coder.settled(added, moved)
    assert ((words >= 0) & (words < 1 << 16)).all()
    for lane, part in enumerate(np.split(words, np.cumsum(used)[:-1])):
        total, shift = 0, 0
        for a, m in zip(added[:, lane].tolist(), moved[:, lane].tolist(), strict=True):
            total += a << (16 * (int(used[lane]) - range_coder.RANGE_WORDS - shift))
            shift += m
        assert sum(w << (16 * k) for k, w in enumerate(part[::-1].tolist())) == total


@pytest.mark.parametrize("vocabulary", [65_535, 65_536, 100_000, range_coder.ID_LIMIT])
def test_coder_round_trip_of_other_vocabularies(vocabulary):
    draw = np.random.default_rng(vocabulary)
    ids = np.where(draw.random(70_001) < 0.7, draw.zipf(1.2, 70_001) % vocabulary,
                   draw.integers(vocabulary - 9, vocabulary, 70_001)).astype(np.int64)
    data = range_coder.encode(ids, vocabulary)
    assert (range_coder.decode(data, len(ids), vocabulary) == ids).all()
