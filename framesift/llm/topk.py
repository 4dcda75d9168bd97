"""Exact nearest vectors by inner product, most of them ruled out by pivots.

Vectors are taken to a space with one more number, where the nearer one has
the larger product: x gets sqrt(M - |x|^2), M being the largest |x|^2, and a
query gets 0, so that |q - x|^2 = |q|^2 + M - 2 q.x. The table of every
vector's distances to a few pivots then bounds its distance to a query from
below by the triangle inequality, hence its score from above. Candidates are
scored in the order of these bounds until the next one can't reach the k-th
best score found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.shared import settled


@dataclass(frozen=True)
class Search:
    """``k`` best of all rows; components times ``scale``, rounded down.
    ``pivots`` are the vectors that come first by the hash of their id;
    queries and candidates meet in blocks of about these sizes, and ``step``
    candidates are scored at a time."""

    k: int = 10
    scale: int = 1024
    pivots: int = 16
    queries: int = 2048
    candidates: int = 8192
    step: int = 256


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists of whole numbers as rows, shorter ones filled up with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(lengths.max(initial=0)))
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all of b; beyond 64 bits, the nearest number that has them."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def squares(a: np.ndarray) -> np.ndarray:
    return (a.astype(np.float64) ** 2).sum(1)


def wide(column: pa.ChunkedArray) -> int:
    return int(pa.compute.max(pa.compute.list_value_length(column)).as_py() or 0)


def indexed(vectors: DataFrame, pivots: np.ndarray, most: float) -> DataFrame:
    """``vec_id, v, away``: every vector with its distances to the pivots."""
    squared = squares(pivots)
    above = np.sqrt(np.maximum(most - squared, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), pivots.shape[1]).astype(np.float64)
            p = np.pad(pivots, ((0, 0), (0, v.shape[1] - pivots.shape[1]))).astype(np.float64)
            lifted = np.sqrt(np.maximum(most - squares(v), 0))
            away = np.sqrt(np.maximum(2 * most - 2 * (v @ p.T + lifted[:, None] * above), 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * len(p), pa.int32()), pa.array(away.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], ["vec_id", "v", "away"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, away array<double>")


def nearest(vectors: DataFrame, asked: Column, search: Search = Search(), vec_id: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest scores, or
    all if there are fewer, ties to the smaller id.

    Queries are the rows for which ``asked``, of ``vec_id``, is true, and
    candidates all rows but the query's own. Vectors that are null or hold
    null or non-finite components, and rows without an id, take no part. Rows
    that repeat an id count once, with their smallest vector. A shorter
    vector's missing components are 0. Other columns are left out whatever
    they're called; without queries or candidates there are no rows.

    Every vector is indexed; only the pivots come from a sample. Queries and
    candidates are dealt over blocks by hash and each pair of blocks is a task
    that returns ``k`` rows a query, whatever the vectors are, so copies of
    one vector weigh no more than others.
    """
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("_v"))
    given = given.where(F.col("vec_id").isNotNull() & usable(F.col("_v")))
    whole = F.transform("_v", lambda x: F.floor(x.cast("double") * search.scale).cast("long"))
    given = given.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(whole).alias("v"))
    given = settled(given, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows, most = given.agg(F.count("*"), F.max(square)).first()
    most = float(most or 0)
    first = given.orderBy(F.xxhash64("vec_id"), "vec_id").limit(search.pivots).collect()
    pivots = matrix(pa.array([r["v"] for r in first], pa.list_(pa.int64())))
    index = settled(indexed(given, pivots, most), "index")
    of_queries = index.where(asked)
    blocks = max(1, -(-rows // search.candidates))
    asked_blocks = max(1, -(-of_queries.count() // search.queries))

    def dealt(frame: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        return frame.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("qb", "cb")

    slack = 1 + 1e-9 * most  # more than what rounding can add up to

    def run(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q) and len(c):
            width = max(wide(q.column("v")), wide(c.column("v")))
            qv, cv = matrix(q.column("v"), width), matrix(c.column("v"), width)
            qp, cp = queries_away(qv, pivots, most), floats(c.column("away"), len(pivots)).T.copy()
            qi, ci, qs = q.column("vec_id").to_numpy(), c.column("vec_id").to_numpy(), squares(qv)
            for k in range(len(q)):
                least = np.zeros(len(c))
                for p in range(len(pivots)):
                    np.maximum(least, np.abs(cp[p] - qp[k, p]), out=least)
                bound = (qs[k] + most - least**2) / 2 + slack + 1e-9 * qs[k]
                bound[ci == qi[k]] = -np.inf
                found, scores = best(qv[k : k + 1], cv, ci, bound, search)
                out.append((np.full(len(found), qi[k]), found, scores))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(x.astype(np.int64)) for x in columns], ["query_id", "vec_id", "score"])

    parts = dealt(of_queries, "qb", asked_blocks, "cb", blocks).cogroup(dealt(index, "cb", blocks, "qb", asked_blocks)).applyInArrow(
        run, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return parts.withColumn("rank", place).where(F.col("rank") <= search.k).select("query_id", "rank", "vec_id", "score")


def floats(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def queries_away(q: np.ndarray, pivots: np.ndarray, most: float) -> np.ndarray:
    p = np.pad(pivots, ((0, 0), (0, max(0, q.shape[1] - pivots.shape[1])))).astype(np.float64)
    q = np.pad(q, ((0, 0), (0, max(0, pivots.shape[1] - q.shape[1])))).astype(np.float64)
    return np.sqrt(np.maximum(squares(q)[:, None] + most - 2 * q @ p.T, 0))


def best(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, bound: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best, scoring in the order of the bounds."""
    order = np.argsort(-bound)
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(order), search.step):
        some = order[start : start + search.step]
        some = some[bound[some] > -np.inf]
        if not len(some) or len(scores) == search.k and bound[some[0]] < scores[-1]:
            break
        scores = np.concatenate((scores, products(query, vectors[some])[0]))
        found = np.concatenate((found, ids[some]))
        kept = np.lexsort((found, -scores))[: search.k]
        found, scores = found[kept], scores[kept]
    return found, scores
