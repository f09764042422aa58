"""One query per operator over its whole table, and the SQL twins that can be written."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import (
    language, line_dedup, mixing, ngram_join, packing, pages, periodic, personal, quality,
    sharding, token_files, topk, turns)
from panelkit.llm.common import WORD, cut
from panelkit.queries.base import table
from panelkit.runtime import new_folder

KEY_SQL = (
    "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

SQL: dict[str, str] = {}


def op1_token_output(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    token_files.write_tokens(table(spark, folder, "documents"), TOKENIZER, path)
    return token_files.read_tokens(spark, path, TOKENIZER).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


SQL["op3_exact_topk"] = """
WITH clean AS (
  SELECT vec_id, row_number() OVER () AS n,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.n <> c.n WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER)
         AS rank, vec_id, score
FROM pairs
QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) <= 10
"""


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SQL["op4_line_dedup"] = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM split),
keyed AS (SELECT doc_id, pos, line, {KEY_SQL} AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, pos, line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, folder, "documents")).select(
        "doc_id", "rep_id", "class_id", "n_links")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).select(
        "doc_id", *quality.FEATURES, "base_failed", "kept", "n_left")


SQL["op6_quality_rules"] = f"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                     lambda w: w <> '') AS words,
         string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
word_places AS (
  SELECT doc_id, unnest(range(len(words))) AS pos, unnest(words) AS word FROM docs),
windows AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER w AS gram, count(*) OVER w AS n
  FROM word_places
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (
  SELECT doc_id, pos FROM windows WHERE n = 8
  QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
spans AS (
  SELECT doc_id, least(8, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 8))
         AS n FROM twice),
repeats AS (SELECT doc_id, sum(n) AS n FROM spans GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, md5(text) AS whole, unnest(range(len(parts))) AS pos,
         unnest(parts) AS line FROM docs),
keyed AS (
  SELECT *, {KEY_SQL} AS key,
         len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))
           AS n
  FROM lines),
dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM keyed WHERE n > 0 GROUP BY doc_id),
long_lines AS (SELECT * FROM keyed WHERE length(key) >= 20),
frequent AS (
  SELECT source, key FROM long_lines GROUP BY source, key
  HAVING count(DISTINCT whole) > 10),
boiler AS (
  SELECT l.doc_id, sum(l.n) AS n FROM long_lines l JOIN frequent f
    ON l.source IS NOT DISTINCT FROM f.source AND l.key = f.key
  GROUP BY l.doc_id),
counted AS (
  SELECT d.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         len(words) - coalesce(b.n, 0) AS n_left
  FROM docs d LEFT JOIN dups u ON d.doc_id = u.doc_id
    LEFT JOIN repeats r ON d.doc_id = r.doc_id LEFT JOIN boiler b ON d.doc_id = b.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND 100 * n_left >= 20 * n_words AS kept,
       CAST(n_left AS BIGINT) AS n_left
FROM counted
"""


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    cuts = packing.pieces(table(spark, folder, "documents"), TOKENIZER)
    return packing.pack(cuts).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    model = language.learn(docs, F.coalesce(~held_out, F.lit(False)))
    return language.predict(
        docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"),
        model).drop("text")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sizes = cut(mixing.sized(table(spark, folder, "documents")), "mix-sizes")
    return mixing.apply_mix(sizes, mixing.plan_mix(sizes)).select(
        "doc_id", "size", "source_size", "target", "taken", "draws")


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    records = sharding.record_sizes(table(spark, folder, "documents"))
    return sharding.assign_shards(records).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def _repeated_words(doc_id, text):
    """The text with its words repeated in a period from some place on, if doc_id asks for it."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    parts = F.struct(words.alias("w"), F.size(words).cast("long").alias("n"), g.alias("g"))
    # A one-element array hands each value on, so that the words are split only once.
    spread = F.transform(F.array(parts), lambda x: F.struct(
        x["w"].alias("w"), x["n"].alias("n"), F.pmod(x["g"], x["n"]).alias("a"),
        F.lit(1).alias("one"), x["g"].alias("g")))
    period = F.transform(spread, lambda x: F.struct(
        x["w"].alias("w"), x["n"].alias("n"), x["a"].alias("a"),
        (1 + F.floor((x["n"] - x["a"]) / (3 + F.pmod(x["g"], F.lit(8))))).alias("p")))

    def repeat(x):
        rest = x["n"] - x["a"]
        unit = F.slice(x["w"], (x["a"] + 1).cast("int"), x["p"].cast("int"))
        tail = F.flatten(F.array_repeat(unit, F.ceil(rest / x["p"]).cast("int")))
        head = F.slice(x["w"], F.lit(1), x["a"].cast("int"))
        return F.array_join(F.concat(head, F.slice(tail, F.lit(1), rest.cast("int"))), " ")

    damaged = F.get(F.transform(F.filter(period, lambda x: x["n"] > 0), repeat), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, damaged).otherwise(text)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = periodic.periodic_runs(docs, "doc_id", _repeated_words(F.col("doc_id"), F.col("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n"))), "")
    best = found.withColumn("_best", longest)
    return best.select(
        F.col("key").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


def _if_equal(value):
    return lambda x: F.when(x == value, x)


def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.personal_spans(table(spark, folder, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _if_equal(kind)))).cast("long").alias(
        f"n_{kind}") for kind in personal.KINDS]
    return found.select(
        F.col("key").alias("doc_id"), *counts,
        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def damaged_conversations(given: DataFrame) -> DataFrame:
    """Conversations with rows lost, emptied, cut, repeated and under a wrong role."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), blank))
    harm = F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(20))
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    copies = F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1)
    return given.select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(
            text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy")).drop("_copy")


def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations")
    done = turns.audits(damaged_conversations(given)).withColumnRenamed("conv_id", "_conv")
    every = given.select("conv_id").distinct()
    joined = every.join(done, every["conv_id"].eqNullSafe(done["_conv"]), "left")
    empty = F.sha2(F.encode(F.lit(""), "UTF-8"), 256)
    return joined.select(
        "conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in turns.TOTALS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_token_output, op2_page_text, op3_exact_topk, op4_line_dedup, op5_ngram_join,
    op6_quality_rules, op7_packing, op8_language_id, op9_mixing, op10_sharding,
    op11_periodic_runs, op12_personal_data, op13_turn_repair)}
