"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a seeded hash, about as many words in each. Its
quota, in blocks, is its target over its size times its blocks: one draw of every block for
each whole pass, and a part of them for the rest. A binary tree divides all quotas among the
output shards: at each node a uniform subset of the node's blocks of the exact size goes
left, so the sources' counts on the left follow the multivariate hypergeometric law. A
shard then takes the next blocks of each source's permuted order, which no other shard
has, and orders its rows by a hash of its own.

The mix takes whole documents. Only the document at which a source's quota ends gives its
first words, so taken words equal the rounded target.

Defined results: a null text has size 0 and is never drawn; null sources are one source
that comes last; rows alike in source, doc_id and text share what falls on them evenly;
empty tables give empty tables; other columns pass through ``mixed_rows`` unless they start
with an underscore or bear the name of a result column.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkit.llm.common import cut, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SHARDS = 8
BLOCKS = 4096
SEED = 17
BITS, DIGIT = 56, 8
# Rows of one source that one window may order: the documents around its quota's end.
EDGE_ROWS = 256

RESULTS = ["size", "source_size", "target", "draws", "taken"]


@dataclass
class MixPlan:
    """``sources``: one row per source. ``edges``: documents at which quotas end."""

    sources: DataFrame
    edges: DataFrame


def place(salt: Column) -> Column:
    """A document's place in its source's order, from 0 to 2^56."""
    mixed = F.xxhash64(F.lit(SEED), salt, "doc_id", "_text")
    return mixed.bitwiseAND(F.lit((1 << BITS) - 1))


def sized(docs: DataFrame) -> DataFrame:
    """The columns that planning needs, without the texts."""
    return docs.select("doc_id", "source", F.xxhash64("text").alias("_text"),
                       word_count(F.col("text")).alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
            most: int = MOST) -> DataFrame:
    """Size and target of each source: weighted shares, none above ``most`` times its size.

    Sources in the order of their caps per weight form a run that is capped and a rest that
    shares by weight. The level of the rest is the largest that any prefix gives, so one
    pass over the sources, which are few, replaces the repeated sharing.
    """
    every = W.partitionBy()
    turn = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1,
                  F.lit(len(weights)))
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = by_source.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    order = W.orderBy(F.col("source_size") / F.col("weight"),
                      F.col("source").asc_nulls_last())
    before = F.coalesce(
        F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    level = (
        (share * F.sum("source_size").over(every) - most * before)
        / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    leveled = weighed.withColumn("_level", level)
    return leveled.withColumn("target", F.least(
        (most * F.col("source_size")).cast("double"),
        F.max("_level").over(every) * F.col("weight"))).drop("_level", "weight")


def quotas(wanted: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Whole passes, words of the rest, and quota in blocks of each source."""
    size, goal = F.col("source_size"), F.round("target").cast("long")
    total = F.sum("source_size").over(W.partitionBy())
    return (
        wanted.withColumn("passes", F.when(size > 0, F.floor(goal / size)).otherwise(0))
        .withColumn("rest", F.when(size > 0, goal - F.col("passes") * size).otherwise(0))
        .withColumn("blocks", F.greatest(
            F.lit(1), F.round(size * blocks / F.greatest(total, F.lit(1))).cast("long")))
        .withColumn("rest_blocks", F.ceil(
            F.col("rest") * F.col("blocks") / F.greatest(size, F.lit(1))))
        .withColumn("quota", F.when(
            size > 0, F.col("passes") * F.col("blocks") + F.col("rest_blocks")).otherwise(0))
    )


def split_quotas(sources: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add ``starts``: where each shard's run of the source's permuted blocks begins.

    The rows that the tree splits are blocks, of which there are about ``BLOCKS`` times the
    share plus one per source and pass, whatever the corpus holds.
    """
    parts = sources.where(F.col("quota") > 0).select(
        "source", F.explode(F.sequence(F.lit(1), F.col("quota"))).alias("i"),
        F.lit(0).alias("low"), F.lit(shards).alias("high"))
    depth = (shards - 1).bit_length()
    for level in range(depth):
        node = W.partitionBy("low", "high")
        drawn = F.row_number().over(
            node.orderBy(F.xxhash64(F.lit(SEED), F.lit(level), "source", "i"),
                         F.col("source"), "i"))
        half = F.floor((F.col("low") + F.col("high") + 1) / 2).cast("int")
        left = F.floor(F.count(F.lit(1)).over(node) * (half - F.col("low"))
                       / (F.col("high") - F.col("low")))
        parts = parts.withColumn("_half", half).withColumn("_left", drawn <= left).select(
            "source", "i",
            F.when(F.col("_left"), F.col("low")).otherwise(F.col("_half")).alias("low"),
            F.when(F.col("_left"), F.col("_half")).otherwise(F.col("high")).alias("high"))
    counted = parts.groupBy("source", "low").agg(F.count(F.lit(1)).alias("n"))
    runs = counted.groupBy("source").agg(
        F.map_from_entries(F.collect_list(F.struct("low", "n"))).alias("_n"))
    given = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                        lambda s: F.coalesce(F.try_element_at("_n", s), F.lit(0)))
    starts = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(
        F.slice("_given", 1, s), F.lit(0).cast("long"), lambda a, x: a + x))
    runs = runs.select("source", given.alias("_given")).select("source", starts.alias("starts"))
    return (
        sources.alias("s")
        .join(runs.alias("r"), F.col("s.source").eqNullSafe(F.col("r.source")), "left")
        .select("s.*", "starts")
    )


def find_edges(sizes: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each source's last pass ends: its place, and the documents in the cell there.

    Places are searched digit by digit: each level counts the words of 256 cells a source
    and goes into the one where the rest of the quota ends, until no cell holds more than
    ``EDGE_ROWS`` documents. Each level is one map-side combined count of narrow rows.
    """
    state = sources.where(F.col("rest") > 0).select(
        F.col("source").alias("_source"), "passes", "rest",
        F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("before"))
    for level in range(1, BITS // DIGIT + 1):
        shift, at = BITS - DIGIT * level, place(F.col("passes"))
        inside = (
            sizes.where(F.col("size") > 0)
            .join(state, F.col("source").eqNullSafe(F.col("_source")))
            .where(F.shiftright(at, shift + DIGIT) == F.col("cell"))
            .withColumn("_digit", F.shiftright(at, shift))
        )
        by_cell = inside.groupBy("_source", "passes", "rest", "before", "_digit").agg(
            F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_rows"))
        upto = F.col("before") + F.sum("_words").over(
            W.partitionBy("_source").orderBy("_digit"))
        state = cut(
            by_cell.withColumn("_upto", upto)
            .where((F.col("_upto") >= F.col("rest"))
                   & (F.col("_upto") - F.col("_words") < F.col("rest")))
            .select("_source", "passes", "rest", F.col("_digit").alias("cell"),
                    (F.col("_upto") - F.col("_words")).alias("before"), "_rows"),
            "mix-cells")
        most = state.agg(F.max("_rows")).first()[0]
        state = state.drop("_rows")
        if most is None or most <= EDGE_ROWS:
            break
    place_now = place(F.col("passes"))
    grouped = (
        sizes.where(F.col("size") > 0)
        .join(state, F.col("source").eqNullSafe(F.col("_source")))
        .where(F.shiftright(place_now, shift) == F.col("cell"))
        .groupBy("source", "doc_id", "_text", "rest", "before", place_now.alias("_at"))
        .agg(F.count(F.lit(1)).alias("_n"), F.max("size").alias("_size"))
    )
    order = W.partitionBy("source").orderBy("_at", "doc_id", "_text")
    words = F.col("_n") * F.col("_size")
    left = F.col("rest") - F.col("before") - (F.sum(words).over(order) - words)
    edges = grouped.select(
        "source", "doc_id", "_text",
        F.floor(F.greatest(F.lit(0), F.least(left, words)) / F.col("_n")).alias("words"))
    ends = state.select("_source", F.shiftleft("cell", shift).alias("end"),
                        F.shiftleft(F.col("cell") + 1, shift).alias("edge_end"))
    return ends, edges


def plan_mix(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST,
             shards: int = SHARDS, blocks: int = BLOCKS) -> MixPlan:
    """``sizes`` comes from ``sized`` and should be a written cut: it is read level by level."""
    sources = cut(quotas(targets(sizes, weights, share, most), blocks), "mix-quotas")
    ends, edges = find_edges(sizes, sources)
    shared = split_quotas(sources, shards)
    full = cut(
        shared.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left")
        .drop("_source"), "mix-sources")
    return MixPlan(full, cut(edges, "mix-edges"))


def apply_mix(docs: DataFrame, plan: MixPlan) -> DataFrame:
    """``docs`` (with ``_text`` and ``size``) and its source's size and target, its draws
    (pass, words, shard) and the words taken."""
    sources = plan.sources.select(
        F.col("source").alias("_source"), F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"), F.col("passes").alias("_passes"),
        F.col("blocks").alias("_blocks"), F.col("rest_blocks").alias("_rest_blocks"),
        F.col("starts").alias("_starts"), F.col("end").alias("_end"),
        F.col("edge_end").alias("_edge_end"))
    edges = plan.edges.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"),
                              F.col("_text").alias("_t"), F.col("words").alias("_words"))
    keep = [c for c in docs.columns if c not in RESULTS]
    joined = (
        docs.select(*keep, "size")
        .join(sources, F.col("source").eqNullSafe(F.col("_source")), "left")
        .join(edges, F.col("source").eqNullSafe(F.col("_s"))
              & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")),
              "left")
        .withColumn("_at", place(F.col("_passes")))
    )
    last = F.when(F.col("_at") < F.col("_end"), F.col("size")).when(
        F.col("_at") < F.col("_edge_end"), F.coalesce("_words", F.lit(0))).otherwise(0)

    def draw(number: Column, words: Column, block: Column) -> Column:
        at = number * F.col("_blocks") + block
        shard = F.size(F.filter("_starts", lambda s: s <= at)) - 1
        return F.struct(number.cast("int").alias("pass"), words.cast("long").alias("words"),
                        shard.cast("int").alias("shard"))

    def block_of(at: Column) -> Column:
        return F.floor(at / F.lit(float(1 << BITS)) * F.col("_blocks"))

    whole = F.when(
        (F.col("_passes") > 0) & (F.col("size") > 0),
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("_passes") - 1),
                    lambda p: draw(p, F.col("size"), block_of(place(p)))))
    part = F.when(last > 0, F.array(draw(F.col("_passes"), last, F.least(
        block_of(F.col("_at")), F.col("_rest_blocks") - 1))))
    none = F.array().cast("array<struct<pass:int,words:bigint,shard:int>>")
    drawn = joined.select(
        *keep, "size", F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.concat(F.coalesce(whole, none), F.coalesce(part, none)).alias("draws"))
    return drawn.withColumn("taken", F.aggregate(
        "draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))


def mixed_rows(docs: DataFrame, plan: MixPlan) -> DataFrame:
    """The mix itself: a row per draw with the words it takes, its shard and local order."""
    columns = [c for c in docs.columns if c not in RESULTS and not c.startswith("_")]
    sizes = docs.select(*columns, F.xxhash64("text").alias("_text"),
                        word_count(F.col("text")).alias("size"))
    drawn = apply_mix(sizes, plan).withColumn("_draw", F.explode("draws"))
    # Words with the white space before them; only the document at a quota's end needs it.
    runs = F.regexp_extract_all(
        "text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    head = F.array_join(F.slice(runs, F.lit(1), F.col("_draw.words").cast("int")), "")
    whole = F.col("_draw.words") == F.col("size")
    taken = {"text": F.when(whole, F.col("text")).otherwise(head)}
    if "n_chars" in columns:
        taken["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(
            F.char_length(head).cast("long"))
    return drawn.select(
        *[taken.get(c, F.col(c)).alias(c) for c in columns],
        F.col("_draw.shard").alias("_shard"), F.col("_draw.pass").alias("_pass"),
        F.xxhash64(F.lit(SEED), F.lit("local"), "_draw.pass", "doc_id", "_text")
        .alias("_order"))
