"""Best-fit packing with bounds that certify it.

Pieces are dealt by hash to partitions of bounded size, and each partition packs its own
by best-fit decreasing. Dual feasible functions give a number of sequences below which no
packing of the partition can go; a partition that reaches it is certified. The same bound
over the lengths of all pieces, at most one count per length, says when all is done: until
then partitions keep their full sequences and exchange the pieces of the others, certified
or not, by a new deal among themselves, and run again. Exchanges end at the bound, where
``IDLE`` of them in a row save nothing, where one closes less than one part in
``LEAST_PART`` of the gap, and where a single certified partition holds all that is left.

Defined results: a null or empty text is one piece with the end id alone; repeated rows are
packed each for itself; an empty table gives an empty table; other columns pass through
``pack`` unless they start with an underscore or are ``sequence_id`` or ``offset``.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.common import cut
from panelkit.llm.tokens import batches, encoder

CAPACITY = 2048
END_ID = 0
# Pieces that one task packs at a time.
PARTITION_ROWS = 50_000
# An exchange that closes a smaller part of the gap to the bound is the last.
LEAST_PART, IDLE = 20, 2
# Sequences of one partition have numbers below this.
NUMBERS = 1 << 28


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY,
           end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each text with its end id; texts stay in place."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut_texts(parts):
        tool = encoder(path)
        for part in parts:
            ids_of = part.column("doc_id")
            for first, texts in batches(part.column("text").to_pylist()):
                ids, lengths = tool.encode(texts)
                rows: list = [[], [], [], [], []]
                at = 0
                for k, n in enumerate(lengths):
                    whole = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    doc = ids_of[first + k]
                    for p, start in enumerate(range(0, len(whole), capacity)):
                        piece = whole[start:start + capacity]
                        for column, value in zip(rows, (
                                doc, p, start, len(piece), zlib.crc32(piece.tobytes())),
                                strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d.as_py() for d in rows[0]], pa.int64()),
                     pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_texts, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Most that dual feasible functions prove for pieces of these lengths."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """The bound from the number of pieces of each length: thresholds and roundings."""
    if not counts.any():
        return 0
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    number = np.cumsum(counts)
    volume = np.cumsum(counts * sizes)
    # Sizes above capacity - t count whole, sizes below t not at all.
    t = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - t]
    middle = volume[capacity - t] - volume[t - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 65):
        exact = (k + 1) * sizes % capacity == 0
        rounded = np.where(exact, k * sizes, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((counts * rounded).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int):
    """Sequence and offset of each length. A bit of ``free`` says that a sequence has so
    much space; the lowest set bit at or above a length is its best fit."""
    sequence = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    spaces: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, opened = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = spaces[space].pop()
            if not spaces[space]:
                free ^= 1 << space
        else:
            space, number = capacity, opened
            opened += 1
        sequence[i], offset[i] = number, capacity - space
        space -= size
        if not spaces[space]:
            free |= 1 << space
        spaces[space].append(number)
    return sequence, offset, opened


def packed(rows: DataFrame, capacity: int, turn: int) -> DataFrame:
    """Pack each ``_part``: sequence, offset, fill of the sequence, and the part's gap."""
    added = ["sequence_id", "offset", "_fill", "_gap", "_used"]
    fields = [f for f in rows.schema.fields if f.name not in added]
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in added)])
    names = [f.name for f in fields]

    def pack_part(table):
        table = table.select(names).sort_by([("_row", "ascending")])
        lengths = table.column("length").to_numpy()
        if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
            raise ValueError(f"lengths must be from 1 to {capacity}")
        sequence, offset, used = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(sequence, weights=lengths).astype(np.int64)[sequence]
        gap = used - lower_bound(lengths, capacity)
        part = table.column("_part")[0].as_py()
        values = (((turn << 28) + part) * NUMBERS + sequence, offset, fill,
                  np.full(len(lengths), gap), np.full(len(lengths), used))
        for name, value in zip(added, values, strict=True):
            table = table.append_column(name, pa.array(value, pa.int64()))
        return table

    return rows.select(*names).groupBy("_part").applyInArrow(pack_part, schema)


def deal(rows: DataFrame, count: int, turn: int, partition_rows: int) -> DataFrame:
    parts = max(1, -(-count // partition_rows))
    return rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(turn), "_row"), F.lit(parts)))


def sequences(df: DataFrame) -> int:
    """Number of sequences: each part says on every row how many it used."""
    per_part = df.groupBy("_part").agg(F.max("_used").alias("n"))
    return per_part.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def total_bound(rows: DataFrame, capacity: int) -> int:
    """The lower bound over all pieces, from their counts per length."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in rows.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return bound_of_counts(counts, capacity)


def pack(rows: DataFrame, capacity: int = CAPACITY, exchanges: int | None = None,
         partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """``rows`` (with a ``length``) placed in sequences: ``sequence_id`` and ``offset``.

    Each turn is one shuffle of narrow rows by part, written before the next. ``exchanges``
    can end them earlier.
    """
    columns = [c for c in rows.columns
               if c not in ("sequence_id", "offset") and not c.startswith("_")]
    numbered = cut(rows.select(*columns).withColumn(
        "_row", F.monotonically_increasing_id()), "pieces")
    count = numbered.count()
    current = cut(packed(deal(numbered, count, 0, partition_rows), capacity, 0), "packed")
    used, bound = sequences(current), total_bound(numbered, capacity)
    done: list[DataFrame] = []
    turn, idle, open_rows = 0, 0, F.col("_fill") < capacity
    while used > bound and turn != exchanges:
        count, before, parts, gaps = current.where(open_rows).agg(
            F.count("*"), F.count_distinct("sequence_id"), F.count_distinct("_part"),
            F.max("_gap")).first()
        if not count or turn and parts == 1 and not gaps:
            break
        turn += 1
        again = cut(packed(
            deal(current.where(open_rows), count, turn, partition_rows), capacity, turn),
            "packed")
        saved, gap = before - sequences(again), used - bound
        idle = 0 if saved > 0 else idle + 1
        if saved >= 0:
            done.append(current.where(~open_rows))
            current, used = again, used - saved
        if idle == IDLE or saved > 0 and saved * LEAST_PART < gap:
            break
    for part in done:
        current = current.unionByName(part)
    return current.select(*columns, "sequence_id", "offset")
