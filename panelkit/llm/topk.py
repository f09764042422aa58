"""Exact top-k by inner product with pivot-table elimination.

Inner products become distances by one more coordinate that brings every candidate to the
largest norm M; a query has 0 there. Distances to pivots are computed once per vector and
kept in a table. For a query, the largest difference of two such distances is a lower bound
of its distance to a candidate and so an upper bound of the score. Candidates are evaluated
in the order of their bounds until the k-th best score is above the bound of the next.

Queries and candidates meet in a grid of blocks of bounded size; each cell gives at most k
rows a query, and a last ranking merges the cells.

Defined results: vectors that are null or hold null or non-finite components, and vectors
without vec_id, take no part; shorter vectors count as padded with zeros; a row is never
its own candidate, but another row with its vec_id may be; ties go to the smaller vec_id;
empty tables give empty tables. A score can be as large as the largest squared length;
vectors that reach 2^63 so are refused.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkit.llm.common import cut

SCALE = 1024
PIVOTS = 24
# Rows among which pivots are sought; only speed depends on them.
PIVOT_SAMPLE = 1024
CANDIDATE_ROWS = 8192
QUERY_ROWS = 2048
CHUNK = 512
EXACT = 1 << 53


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Numbered rows that take part, with components floor(scale * x)."""
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
    ).select(F.monotonically_increasing_id().alias("_row"),
             F.col("vec_id").cast("long"), values.alias("x"))


def matrix(column, width: int) -> np.ndarray:
    """Vectors of a list column as rows, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), flat.dtype)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def choose_pivots(rows: DataFrame, width: int, count: int = PIVOTS) -> np.ndarray:
    """Rows far from each other among a bounded sample by hash."""
    sample = [r["x"] for r in rows.orderBy(F.xxhash64("x"), "_row").limit(PIVOT_SAMPLE).collect()]
    points = np.zeros((len(sample), width))
    for p, x in zip(points, sample, strict=True):
        p[:len(x)] = x
    chosen = [0]
    far = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def pivot_table(rows: DataFrame, pivots: np.ndarray, largest: float) -> DataFrame:
    """Add each row's distances to the pivots, as candidate and as query."""
    width = pivots.shape[1]
    lift = np.sqrt(np.maximum(largest - (pivots ** 2).sum(1), 0))

    def measure(parts):
        for part in parts:
            x = matrix(part.column("x"), width).astype(float)
            norms = (x ** 2).sum(1)
            lifted = np.sqrt(np.maximum(largest - norms, 0))
            near = x @ pivots.T
            as_candidate = np.sqrt(np.maximum(
                2 * largest - 2 * (near + np.outer(lifted, lift)), 0))
            as_query = np.sqrt(np.maximum(norms[:, None] + largest - 2 * near, 0))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(list(as_candidate), pa.list_(pa.float64())),
                 pa.array(list(as_query), pa.list_(pa.float64()))],
                ["_row", "vec_id", "x", "candidate", "query"])

    return rows.mapInArrow(
        measure, "_row long, vec_id long, x array<bigint>, candidate array<double>, "
                 "query array<double>")


def best_of_cell(queries: pa.Table, candidates: pa.Table, k: int, width: int,
                 largest: float) -> pa.Table:
    """The k best candidates of each query of a cell, by bounds until none can be better."""
    x, q = matrix(candidates["x"], width), matrix(queries["x"], width)
    ids, rows = candidates["vec_id"].to_numpy(), candidates["_row"].to_numpy()
    order = np.argsort(ids, kind="stable")
    x, ids, rows = x[order], ids[order], rows[order]
    table = np.stack(candidates["candidate"].to_numpy(zero_copy_only=False))[order]
    to_pivots = np.stack(queries["query"].to_numpy(zero_copy_only=False))
    norms = (q.astype(float) ** 2).sum(1)
    if largest + norms.max(initial=0) < EXACT:
        x, q = x.astype(float), q.astype(float)
    slack = 1 + 1e-9 * (largest + norms)
    own = queries["_row"].to_numpy()
    found = []
    for i, query in enumerate(q):
        bound = np.abs(table - to_pivots[i]).max(1)
        bound = (norms[i] + largest - bound ** 2) / 2 + slack[i]
        turn = np.argsort(-bound, kind="stable")
        scores = np.zeros(0, np.int64)
        at = np.zeros(0, np.int64)
        for begin in range(0, len(turn), CHUNK):
            if len(scores) == k and scores[-1] > bound[turn[begin]]:
                break
            some = turn[begin:begin + CHUNK]
            some = some[rows[some] != own[i]]
            scores = np.concatenate([scores, (x[some] @ query).astype(np.int64)])
            at = np.concatenate([at, some])
            # Candidates are in the order of vec_id, so a place breaks ties.
            best = np.lexsort((at, -scores))[:k]
            scores, at = scores[best], at[best]
        found.append((np.full(len(at), i), ids[at], scores))
    which, vec_id, score = (np.concatenate(c) if found else np.zeros(0, np.int64)
                            for c in zip(*found, strict=True))
    return pa.table({
        "_query": pa.array(own[which], pa.int64()),
        "query_id": pa.array(queries["vec_id"].to_numpy()[which], pa.int64()),
        "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, pa.int64())})


def top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k best rows for each row whose vec_id is divisible by ``every``."""
    result = "_query long, query_id long, vec_id long, score long"
    rows = cut(scaled(vectors), "vectors")
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    count, asking, width, largest = rows.agg(
        F.count("*"), F.count_if(is_query), F.max(F.size("x")), F.max(norm)).first()
    if largest is not None and largest >= float(1 << 62):
        raise ValueError("scores could pass 2^63: scale the vectors down")
    if not asking:
        empty = rows.sparkSession.createDataFrame([], result)
        return empty.withColumn("rank", F.lit(1)).select("query_id", "rank", "vec_id", "score")
    known = cut(pivot_table(rows, choose_pivots(rows, width), largest), "pivot-table")
    across, down = -(-count // CANDIDATE_ROWS), -(-asking // QUERY_ROWS)

    def blocks(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def block(n: int):
        return F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")

    left = known.where(is_query).select(
        "_row", "vec_id", "x", "query", block(down).alias("down"), blocks(across).alias("across"))
    right = known.select(
        "_row", "vec_id", "x", "candidate", block(across).alias("across"),
        blocks(down).alias("down"))

    def cell(queries, candidates):
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({n: pa.array([], pa.int64())
                             for n in ("_query", "query_id", "vec_id", "score")})
        return best_of_cell(queries, candidates, k, width, largest)

    met = left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInArrow(
        cell, result)
    rank = F.row_number().over(W.partitionBy("_query").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
