"""A corpus pipeline: quality rules, line dedup, near-copy join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written and read again
before the next. All stages but the last return the columns of ``documents``. Other columns,
whatever their names, are left out at the first stage that meets them.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import line_dedup, mixing, ngram_join, packing, quality
from panelkit.llm.common import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with their texts as they are.

    A document and its verdict meet on doc_id, source and a hash of the text, so repeated
    rows, rows without doc_id and equal ids of different texts each get their own.
    """
    docs = docs.select(*COLUMNS)
    kept = quality.judge(docs).where("kept").select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("_text").alias("_t"))
    same = (F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s"))
            & (F.xxhash64("text") == F.col("_t")))
    return docs.join(kept, same, "left_semi")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share; all documents stay."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose word 5-grams agree to 0.8 or more."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources at their target weights; a document may come twice."""
    docs = docs.select(*COLUMNS)
    sizes = cut(mixing.sized(docs), "mix-sizes")
    return mixing.mixed_rows(docs, mixing.plan_mix(sizes)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: every piece of every document with its place."""
    return packing.pack(packing.pieces(docs.select(*COLUMNS), TOKENIZER)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_copies),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

# Hash orders decide which documents are drawn and how they are packed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
