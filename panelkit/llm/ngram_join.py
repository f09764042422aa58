"""Similarity join on word n-grams: MinHash bands find candidates, full sets verify them.

Texts are compared as sets of ``WORDS``-word shingles; a shorter text is one shingle. Texts
with equal sets are one class and meet as one representative. Band and row counts follow
from the similarity and the target recall. Class rows are shuffled on band hashes, and each
bucket links its members to its smallest, never all pairs. Components of these links hold
all candidates; inside them full sets are intersected by matrix products, in a grid of
blocks of bounded size where a component is large. A cell emits a count of links and a root
per class, so neither pairs nor buckets are written out.

Defined results: a null text or one without words is alone with no link; repeated rows are
copies of each other; rows without doc_id are compared as others, and a class takes their
null id only if it has no other; empty tables give empty tables; other columns play no part.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import cut
from panelkit.llm.components import stars

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99999
MOST_HASHES = 128
# Classes of one block of a large component, and of the small components of one task.
BLOCK = 1024
UNIT_CLASSES = 2048
# Columns of one matrix product.
COLUMNS = 16384
SEED = 20
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def banding(similarity: float = SIMILARITY, recall: float = RECALL,
            most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows a band whose bands reach the recall at the similarity."""
    best = None
    for rows in range(1, most + 1):
        hit = similarity ** rows
        bands = 1 if hit >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-hit))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding within so many hashes reaches the recall")
    return best


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of them."""
    while len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            old = _POWERS[k]
            step = np.uint64(pow(base, len(old), 1 << 64))
            _POWERS[k] = np.concatenate([old, old * step])
    return _POWERS[0], _POWERS[1]


def word_hashes(text: str) -> np.ndarray:
    """A hash per word: differences of one running sum over all bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    each = word_hashes(text or "")
    if not len(each):
        return each
    size = min(words, len(each))
    total = np.full(len(each) - size + 1, size, np.uint64)
    for k in range(size):
        total += each[k:len(each) - size + 1 + k] * np.uint64((2 * k + 1) * BASE & MASK)
    return np.unique(mixed(total))


def minima(hashes: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function."""
    best = np.full(len(times), MASK, np.uint64)
    for k in range(0, len(hashes), 1024):
        values = hashes[None, k:k + 1024] * times[:, None]
        values += plus[:, None]
        np.minimum(best, values.min(1), out=best)
    return best


def identity(docs: DataFrame) -> list:
    """128 bits that tell rows of different doc_id or text apart."""
    return [F.xxhash64("doc_id", "text").alias("_k1"),
            F.xxhash64(F.lit(1), "doc_id", "text").alias("_k2")]


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Per document: identity, number of shingles, 128 bits of the set, and band hashes."""
    draw = np.random.default_rng(SEED)
    times = draw.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    plus = draw.integers(0, 1 << 63, bands * rows, np.uint64)
    weights = draw.integers(0, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
    names = ["doc_id", "_k1", "_k2", "n", "d1", "d2", "bands"]

    def sketch(parts):
        for part in parts:
            out: list = [[], [], [], []]
            for text in part.column("text").to_pylist():
                have = shingles(text, words)
                low = minima(have, times, plus).reshape(bands, rows)
                band = mixed((low * weights).sum(1, dtype=np.uint64))
                out[0].append(len(have))
                out[1].append(have.sum(dtype=np.uint64))
                out[2].append((have * np.uint64(BASE) ^ (have >> np.uint64(7))).sum(
                    dtype=np.uint64))
                out[3].append(band.view(np.int64) if len(have) else [])
            sums = [np.array(s, np.uint64).view(np.int64) for s in out[1:3]]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in names[:3]), pa.array(out[0], pa.int64()),
                 *(pa.array(s, pa.int64()) for s in sums),
                 pa.array(out[3], pa.list_(pa.int64()))], names)

    return docs.select(F.col("doc_id").cast("long"), *identity(docs), "text").mapInArrow(
        sketch, "doc_id long, _k1 long, _k2 long, n long, d1 long, d2 long, bands array<bigint>")


def set_classes(known: DataFrame) -> DataFrame:
    """One row per set of shingles: number ``cls``, representative, members and bands."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "_k1", "_k2"))
    return (
        known.where("n > 0").groupBy("d1", "d2")
        .agg(first.alias("r"), F.count("*").alias("members"), F.first("bands").alias("bands"))
        .select("d1", "d2", F.monotonically_increasing_id().alias("cls"),
                F.col("r.doc_id").alias("rep_id"), F.col("r._k1").alias("_k1"),
                F.col("r._k2").alias("_k2"), "members", "bands")
    )


def candidates(classes: DataFrame) -> DataFrame:
    """Links from the members of each band bucket to its smallest class."""
    rows = classes.select("cls", F.posexplode("bands").alias("band", "value"))
    buckets = cut(
        rows.groupBy("band", "value").agg(F.min("cls").alias("b"), F.max("cls").alias("_m"))
        .where("b < _m").drop("_m"), "buckets")
    return rows.join(buckets, ["band", "value"]).where("cls <> b").select(
        F.col("cls").alias("a"), "b").distinct()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections; shingles that only one set has play no part."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = count[place] > 1
    owner, place = owner[both], place[both]
    used, place = np.unique(place, return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for k in range(0, len(used), COLUMNS):
        at = slice(*np.searchsorted(place, [k, k + COLUMNS]))
        width = min(COLUMNS, len(used) - k)
        grid = np.zeros((len(sets), width), np.float32)
        grid[owner[at], place[at] - k] = 1
        out += grid @ grid.T
    return out


def linked_pairs(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Matrix of links between sets, without the diagonal."""
    size = np.array([len(s) for s in sets], np.float64)
    shared = shared_counts(sets).astype(np.float64)
    link = shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-9
    np.fill_diagonal(link, False)
    return link


def roots_of(link: np.ndarray) -> np.ndarray:
    """The smallest index each one is linked with, over any number of links."""
    root = np.arange(len(link))
    while True:
        near = np.where(link, root[None, :], len(link)).min(1, initial=len(link))
        new = np.minimum(root, near)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def verify(cell: pa.Table, words: int, similarity: float) -> pa.Table:
    """Links inside one cell: per class with any, its root there and its number of links."""
    rows = {}
    for row in cell.select(["comp", "cls", "side", "members", "text"]).to_pylist():
        rows.setdefault(row["comp"], {})[row["cls"]] = row
    cross = cell["low"][0].as_py() != cell["high"][0].as_py()
    out: list = [[], [], [], []]
    for comp, by_class in rows.items():
        names = sorted(by_class)
        link = linked_pairs([shingles(by_class[c]["text"], words) for c in names], similarity)
        if cross:
            side = np.array([by_class[c]["side"] for c in names])
            link &= side[:, None] != side[None, :]
        members = np.array([by_class[c]["members"] for c in names])
        counts, root = link @ members, roots_of(link)
        for i in np.flatnonzero(link.any(1)):
            for column, value in zip(
                    out, (comp, names[i], names[root[i]], int(counts[i])), strict=True):
                column.append(value)
    return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(
        ("comp", "cls", "root", "links"), out, strict=True)})


def cells(docs: DataFrame, classes: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """Texts of candidate classes, dealt to cells (comp or unit, low, high)."""
    members = cut(
        found.select(F.col("a").alias("cls"), F.col("b").alias("comp"))
        .unionByName(found.select(F.col("b").alias("cls"), F.col("b").alias("comp")).distinct()),
        "candidates")
    sizes = cut(members.groupBy("comp").agg(F.count("*").alias("size")), "component-sizes")
    total = members.count()
    units = max(1, -(-total // UNIT_CLASSES))
    placed = (
        members.join(sizes, "comp")
        .join(classes.select("cls", "_k1", "_k2", "members"), "cls")
        .withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
        .withColumn("side", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .drop("size")
    )
    # Candidates grow with the corpus, so the texts go the same way at any size.
    texts = docs.select(*identity(docs), "text").join(
        cut(placed, "candidate-classes").hint("merge"), ["_k1", "_k2"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    small = F.col("blocks") == 1
    return texts.withColumn("other", other).select(
        F.when(small, -1 - F.pmod(F.xxhash64("comp"), F.lit(units))).otherwise(F.col("comp"))
        .alias("unit"),
        F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"),
        "comp", "cls", "side", "members", "text")


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY,
                recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, its identity (``_k1``, ``_k2``), ``rep_id`` (the
    smallest doc_id of its set of shingles), ``class_id`` (the smallest of all that links
    lead to), ``n_links`` (documents at least so similar) and ``keeper``, true on the rows of
    one identity of each class."""
    bands, rows = banding(similarity, recall)
    known = cut(sketches(docs, words, bands, rows), "sketches")
    classes = cut(set_classes(known), "set-classes")
    found = stars(candidates(classes))
    checked = cut(
        cells(docs, classes, found, block).groupBy("unit", "low", "high").applyInArrow(
            lambda cell: verify(cell, words, similarity),
            "comp long, cls long, root long, links long"), "verified")
    # A class of a large component has a root in each cell; links join these again.
    joined = stars(checked.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    counts = checked.groupBy("cls").agg(F.sum("links").alias("links"))
    named = (
        classes.drop("bands")
        .join(joined.select(F.col("a").alias("cls"), F.col("b").alias("_root")), "cls", "left")
        .withColumn("_root", F.coalesce("_root", "cls"))
    )
    heads = named.groupBy("_root").agg(F.min(F.struct(
        F.col("rep_id").isNull().alias("x"), "rep_id", "_k1", "_k2")).alias("h"))
    full = cut(
        named.join(heads, "_root").join(counts, "cls", "left")
        .select("d1", "d2", "rep_id", "members", F.col("h.rep_id").alias("class_id"),
                F.col("h._k1").alias("_h1"), F.col("h._k2").alias("_h2"),
                F.coalesce("links", F.lit(0)).alias("links")), "named-classes")
    alone = F.col("members").isNull()
    return known.select("doc_id", "_k1", "_k2", "d1", "d2").join(
        full, ["d1", "d2"], "left").select(
        "doc_id", "_k1", "_k2",
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep_id")).alias("rep_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("members") - 1)
        .cast("long").alias("n_links"),
        (alone | ((F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2"))))
        .alias("keeper"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near copies."""
    kept = near_copies(docs).where("keeper").select("_k1", "_k2").distinct()
    columns = [c for c in docs.columns if not c.startswith("_")]
    return docs.select(*columns, *identity(docs)).join(
        kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).drop("_k1", "_k2")
