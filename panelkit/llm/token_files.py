"""Token files: ids of all documents in ascending doc_id order, range-coded in blocks.

The file format is a folder of Parquet files, one row per block: ``shard`` and ``block``
(together the order), ``first`` (ids of the shard before it), ``doc_ids`` and ``lengths``
of its documents, ``payload`` (see ``range_coder``) and ``checksum``, the CRC-32 of the
payload. A block holds whole documents and is coded by itself, so any row decodes alone and
a lost task is written again by Spark.

Defined results: a null or empty text has the end id alone; rows without doc_id come first;
repeated rows are written each, next to each other; an empty table gives an empty file set;
other columns are not part of the file.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkit.llm import range_coder
from panelkit.llm.tokens import batches, encoder

END_ID = 1
# A block is closed by the document that brings it to so many ids.
BLOCK_IDS = 1 << 19

BLOCKS = ("shard int, block int, first long, doc_ids array<bigint>, lengths array<bigint>, "
          "payload binary, checksum long")


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID,
                 block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts. Texts are shuffled once, by range of doc_id; rows that
    share a doc_id may be spread by their text."""

    def code(parts):
        tool = encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        state = {"block": 0, "first": 0}
        held: list = [[], [], [], 0]

        def block():
            docs_in, lengths, runs, n = held
            payload = range_coder.encode(np.concatenate(runs).astype(np.int64), tool.size)
            row = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([state["block"]], pa.int32()),
                pa.array([state["first"]], pa.int64()),
                pa.array([docs_in], pa.list_(pa.int64())),
                pa.array([lengths], pa.list_(pa.int64())),
                pa.array([payload], pa.binary()),
                pa.array([range_coder.checksum(payload)], pa.int64())],
                ["shard", "block", "first", "doc_ids", "lengths", "payload", "checksum"])
            state["block"] += 1
            state["first"] += n
            held[:] = [[], [], [], 0]
            return row

        for part in parts:
            doc_ids = part.column("doc_id").to_pylist()
            for first, texts in batches(part.column("text").to_pylist()):
                ids, lengths = tool.encode(texts)
                at = 0
                for k, n in enumerate(lengths.tolist()):
                    held[0].append(doc_ids[first + k])
                    held[1].append(n + 1)
                    held[2].append(np.append(ids[at:at + n], np.uint32(end_id)))
                    held[3] += n + 1
                    at += n
                    if held[3] >= block_ids:
                        yield block()
        if held[0]:
            yield block()

    key = ["doc_id", "_text"]
    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_text"))
        .repartitionByRange(*key).sortWithinPartitions(*key).drop("_text"))
    ordered.mapInArrow(code, BLOCKS).write.option("compression", "none").parquet(folder)


def read_tokens(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """One row per document from the files: doc_id, its ids (little-endian unsigned 32-bit
    integers), n_tokens, and start, the ids of all documents before it."""
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    # One row per shard, that is, per written task, whatever the files hold.
    totals = blocks.select("shard", F.aggregate(
        "lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("_n")).groupBy(
        "shard").agg(F.sum("_n").alias("_n"))
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    placed = blocks.join(F.broadcast(bases), "shard").withColumn(
        "first", F.col("first") + F.col("_base")).drop("_base")

    def decode(parts):
        size = encoder(tokenizer).size
        for part in parts:
            for row in part.to_pylist():
                if range_coder.checksum(row["payload"]) != row["checksum"]:
                    raise ValueError(f"block {row['shard']}/{row['block']} is damaged")
                lengths = np.array(row["lengths"], np.int64)
                ids = range_coder.decode(row["payload"], int(lengths.sum()), size)
                ids = ids.astype("<u4")
                ends = np.cumsum(lengths)
                texts = [ids[e - n:e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["first"] + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array(texts, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
