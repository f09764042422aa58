"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, ranges.

Records are ordered by key: ``doc_id`` (null first), then a hash of the text, then a number
that tells repeated rows apart. A range is divided at the quantiles of a sample of its keys
in which a record's chance grows with its size; ranges that still hold too many records are
divided again by samples of their own. Sums of whole ranges then give the bytes before each
range, and windows inside ranges the bytes before each record, so a shard ends at the very
record where its share of all bytes does, whatever the samples were.

Defined results: a null text has size 1 and the checksum of no bytes; repeated rows lie next
to each other; an empty table gives an empty table; other columns pass through ``shard_rows``
and give way to result columns.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkit.llm.common import cut

SHARDS = 8
FAN_OUT = 64
SAMPLES_PER_RANGE = 1024
# Narrow rows that one window orders. Ranges above are divided again.
RANGE_ROWS = 100_000
LEVELS = 10
KEY = ("doc_id", "_text", "_row")


def record_sizes(docs: DataFrame) -> DataFrame:
    """Key, size and checksum of each record, without the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", F.xxhash64("text").alias("_text"),
        F.monotonically_increasing_id().alias("_row"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def divide(rows: DataFrame, level: int, fan_out: int, samples: int) -> DataFrame:
    """Replace ``_range`` by one of ``fan_out`` ranges inside it, at sampled quantiles."""
    key = F.struct(*KEY)
    totals = rows.groupBy("_range").agg(F.sum("size").alias("_all"))
    chance = samples * F.col("size") / F.col("_all")
    draw = (F.xxhash64(F.lit(level), *KEY).bitwiseAND(F.lit((1 << 52) - 1))
            / F.lit(float(1 << 52)))
    sampled = rows.join(totals, "_range").where(draw < chance).groupBy("_range").agg(
        F.array_sort(F.collect_list(key)).alias("_keys"))
    n = F.size("_keys")
    bounds = cut(sampled.select("_range", F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.lit(fan_out - 1)),
        lambda i: F.get("_keys", F.floor(i * n / fan_out).cast("int")))).alias("_bounds")),
        "splitters")
    inside = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= key)), F.lit(0))
    return rows.join(bounds, "_range", "left").select(
        *[c for c in rows.columns if c != "_range"],
        (F.col("_range") * fan_out + F.greatest(inside, F.lit(0))).alias("_range"))


def assign_shards(records: DataFrame, shards: int = SHARDS, fan_out: int = FAN_OUT,
                  samples: int = SAMPLES_PER_RANGE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``records`` (from ``record_sizes``) with ``shard`` and the gapless ``slot`` in it."""
    rows = cut(records.withColumn("_range", F.lit(0).cast("decimal(38,0)")), "records")
    for level in range(LEVELS):
        rows = cut(divide(rows, level, fan_out, samples), "ranges")
        fullest = rows.groupBy("_range").count().agg(F.max("count")).first()[0]
        if fullest is None or fullest <= range_rows:
            break
    # One row per range: a small fraction of the records, in key order.
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = cut(
        rows.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_n"))
        .select(
            "_range",
            F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(W.partitionBy()).alias("_total")), "range-sums")
    inside = W.partitionBy("_range").orderBy(*KEY)
    before = F.col("_bytes_before") + F.col("_inside") - F.col("size")
    placed = cut(
        rows.withColumn("_inside", F.sum("size").over(inside))
        .withColumn("_n", F.row_number().over(inside))
        .join(ranges, "_range")
        .withColumn("shard", F.floor(
            (before * shards).cast("decimal(38,0)") / F.col("_total")).cast("int"))
        .withColumn("_index", F.col("_rows_before") + F.col("_n") - 1)
        .select(*[c for c in records.columns], "shard", "_index"), "placed")
    # At most one row per shard.
    first = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    return placed.join(F.broadcast(first), "shard").withColumn(
        "slot", F.col("_index") - F.col("_first")).drop("_index", "_first")


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, one partition run per shard, ready to write.

    Rows alike in doc_id and text take the slots of their group in any order.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    numbered = assign_shards(record_sizes(docs), shards)
    copy = F.row_number().over(W.partitionBy("doc_id", "_text").orderBy(F.lit(0)))
    left = docs.select(*columns).withColumn("_text", F.xxhash64("text")).withColumn("_i", copy)
    right = numbered.select("doc_id", "_text", "shard", "slot").withColumn("_i", copy)
    same = (F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
            & (F.col("d._text") == F.col("p._text")) & (F.col("d._i") == F.col("p._i")))
    return (
        left.alias("d").join(right.alias("p"), same)
        .select(*[F.col(f"d.{c}") for c in columns], "shard", "slot")
        .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot"))
