"""Quality rules: word and symbol counts of a text, and line frequency across documents.

A document passes when it meets the base rules and is not depleted: at least
``LEFT_PERCENT`` of its words stand in lines that are not frequent on its host. The host
of a document is its ``source``. A line (its key of 20 code points or more) is frequent on
a host when more than ``MAX_DOCUMENTS`` distinct documents of the host hold it.

Exact copies are one document here: distinct documents are told apart by a hash of the whole
text, so a text that was copied a thousand times is not taken for boilerplate; that is left
to deduplication. Texts that differ anywhere are different documents, so the pages of one
template count each.

Defined results: a null text has no word and fails the base rules; documents without
source form one host; repeated rows get the same result and count once; an empty table
gives an empty table; other columns pass through unless they start with an underscore or bear
the name of a result column.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import (
    SPACE_RUN, SPACES, cut, line_key, lines_of, two_hashes, word_count)

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
MIN_POINTS = 20
MAX_DOCUMENTS = 10
LEFT_PERCENT = 20
SYMBOLS = r"[#*$%&|<>]"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def shifted(name: str, by: int) -> Column:
    """Hashes of a run and of the run ``by`` places on, joined to one hash."""
    return F.zip_with(
        name, F.slice(name, by + 1, F.greatest(F.size(name), F.lit(1))),
        lambda a, b: F.xxhash64(a, b))


def features(df: DataFrame) -> DataFrame:
    """``df`` with the five counts of its ``text``, all in one pass over each text.

    Hashes of 8-word windows are built by doubling: 1, 2, 4 and 8 words. Only a text that
    has two equal windows sorts them to find which words they cover.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    with_word = F.filter(lines_of(F.col("text")), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    keep = [c for c in df.columns if c not in FEATURES]
    counted = df.select(
        *keep,
        F.when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, SPACE_RUN)).alias("_words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        with_word.alias("_rows"),
    ).select(
        *keep, "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_rows") - F.size(F.array_distinct("_rows"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_w1"),
    )
    names = [*keep, "n_symbols", "n_words", "word_chars", "n_dup_lines"]
    for by in (1, 2, 4):
        counted = counted.select(*names, shifted(f"_w{by}", by).alias(f"_w{2 * by}"))
    whole = counted.select(
        *names,
        F.slice("_w8", 1, F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0)))
        .alias("_w"))
    by_hash = F.array_sort(F.transform(
        "_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = whole.select(*names, F.when(
        F.size(F.array_distinct("_w")) < F.size("_w"), by_hash).alias("_s"))
    next_same = F.zip_with(
        "_s", F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))),
        lambda a, b: a["h"].eqNullSafe(b["h"]))
    flagged = ordered.select(*names, "_s", next_same.alias("_f"))
    repeated = F.zip_with(
        "_f", F.concat(F.array(F.lit(False)), F.col("_f")), lambda a, b: a | b)
    places = F.sort_array(F.array_compact(F.zip_with(
        "_s", repeated, lambda s, f: F.when(f, s["i"]))))
    found = flagged.select(*names, places.alias("_p"))
    steps = F.zip_with(
        "_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))),
        lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0), lambda total, x: total + x)
    return found.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def host_lines(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """One row per long line: its document and host, hash of the text, key hash, words."""
    lines = F.filter(
        F.transform(lines_of(F.col("text")), lambda x, i: F.struct(
            i.alias("pos"), line_key(x).alias("key"), word_count(x).alias("n"))),
        lambda x: F.char_length(x["key"]) >= min_points)
    return (
        docs.select("doc_id", "source", F.xxhash64("text").alias("_text"), lines.alias("_l"))
        .select("doc_id", "source", "_text", F.explode("_l").alias("line"))
        .select("doc_id", "source", "_text", F.col("line.pos").alias("pos"),
                F.col("line.n").alias("n"), *two_hashes(F.col("line.key")))
    )


def frequent_places(docs: DataFrame, max_documents: int = MAX_DOCUMENTS,
                    min_points: int = MIN_POINTS) -> DataFrame:
    """One row per frequent line of a document: its position and words."""
    lines = cut(host_lines(docs, min_points), "host-lines")
    frequent = cut(
        lines.groupBy("source", "h1", "h2")
        .agg(F.count_distinct("_text").alias("_n"))
        .where(F.col("_n") > max_documents)
        .drop("_n"), "frequent-lines")
    same_line = (
        F.col("l.source").eqNullSafe(F.col("f.source"))
        & (F.col("l.h1") == F.col("f.h1")) & (F.col("l.h2") == F.col("f.h2")))
    # A document that is repeated as a row has each of its lines once here.
    return (
        lines.alias("l").join(frequent.alias("f"), same_line, "left_semi")
        .dropDuplicates(["doc_id", "source", "_text", "pos"]))


def same_document(left: str, right: str) -> Column:
    return (
        F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))
        & F.col(f"{left}.source").eqNullSafe(F.col(f"{right}.source"))
        & (F.col(f"{left}._text") == F.col(f"{right}._text")))


def judge(docs: DataFrame, max_documents: int = MAX_DOCUMENTS,
          left_percent: int = LEFT_PERCENT, min_points: int = MIN_POINTS) -> DataFrame:
    """One row per row of ``docs``: its columns but the text, which is left as its hash
    ``_text``, the counts, ``n_left`` words outside frequent lines, ``base_failed``, ``kept``.

    Texts are not moved: lines travel as hashes, counts as numbers.
    """
    boiler = (
        frequent_places(docs, max_documents, min_points)
        .groupBy("doc_id", "source", "_text").agg(F.sum("n").alias("_boiler")))
    results = ("text", "base_failed", "kept", "n_left", *FEATURES)
    copies = [c for c in docs.columns if c not in results and not c.startswith("_")]
    # Written, so that a filter on the verdict does not repeat the counting below it.
    rows = cut(features(docs.select(*copies, "text", F.xxhash64("text").alias("_text")))
               .drop("text"), "features")
    left = F.greatest(F.col("n_words") - F.coalesce("_boiler", F.lit(0)), F.lit(0))
    return (
        rows.alias("d").join(boiler.alias("b"), same_document("d", "b"), "left")
        .select(*[F.col(f"d.{c}") for c in [*copies, "_text", *FEATURES]], left.alias("n_left"))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed")
                    & (100 * F.col("n_left") >= left_percent * F.col("n_words")))
    )


def without_frequent(docs: DataFrame, max_documents: int = MAX_DOCUMENTS,
                     min_points: int = MIN_POINTS) -> DataFrame:
    """``docs`` with ``text`` without the lines that are frequent on its host.

    Lines go by position, as in line dedup; null texts and other columns stay as they are.
    All documents stay; whether one is depleted is ``judge``'s to say.
    """
    lost = (
        frequent_places(docs, max_documents, min_points)
        .groupBy("doc_id", "source", "_text").agg(F.collect_set("pos").alias("_lost")))
    split = docs.withColumns({
        "_text": F.xxhash64("text"), "_lines": lines_of(F.col("text"))})
    # The lines come through the join as a column, so the lambda picks from it.
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost")),
        lambda i: F.get("_lines", i))
    text = F.when(F.col("_lost").isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n"))
    return split.alias("d").join(lost.alias("l"), same_document("d", "l"), "left").select(
        *[text.alias(c) if c == "text" else F.col(f"d.{c}")
          for c in docs.columns if not c.startswith("_")])
