"""Exact search for the highest inner products, by branch and bound over blocks of dimensions.

Queries and candidates are dealt into blocks of bounded size and meet block by block. In a cell the candidates lie in
vertical layout, one row for each dimension. The products are added up a few dimensions at a time; what the remaining
dimensions can still add is bounded by the remaining lengths of both vectors (Cauchy-Schwarz). Candidates whose bound
falls below the k-th best certain score are dropped and the rest is compacted, so later dimensions look at few
candidates. Arithmetic is exact, so no candidate is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

QUERIES_IN_BLOCK = 1024
CANDIDATES_IN_BLOCK = 8192
DIMENSIONS_IN_BLOCK = 8
_EXACT = 1 << 20  # components below that keep every partial sum of 2 ** 13 dimensions exact in a double


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """``id`` and ``v``, the components as ``floor(scale * x)``.

    Rows with a null id or vector, or with a null or non-finite component, are left out.
    """
    x = F.col(f"`{embedding}`")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(F.col(f"`{vec_id}`").isNotNull() & x.isNotNull() & finite).select(
        F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint")).alias("v"))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(counts), dims), dtype=np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _longest(table: pa.Table) -> int:
    return max((len(v) for v in table.column("v")), default=0) if table.num_rows else 0


def best_in_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number and the ids and scores of its best ``k`` candidates; a query skips its own id."""
    dims = vectors.shape[1]
    large = max(np.abs(vectors).max(initial=0), np.abs(queries).max(initial=0)) > _EXACT
    if large:  # far outside of any embedding: whole numbers of any size, no bounds
        yield from _plain(queries, query_ids, vectors, ids, k)
        return
    order = np.argsort(-(vectors.astype(float) ** 2).sum(axis=0), kind="stable")
    columns = np.ascontiguousarray(vectors.T[order]).astype(float)
    cuts = list(range(0, dims, DIMENSIONS_IN_BLOCK)) + [dims]
    squares = columns**2
    left = [np.sqrt(squares[cut:].sum(axis=0)) for cut in cuts]
    queries = queries[:, order].astype(float)
    for number, q in enumerate(queries):
        alive = np.flatnonzero(ids != query_ids[number])
        partial = np.zeros(len(alive))
        whole = columns if len(alive) == len(ids) else None
        for b, (begin, end) in enumerate(zip(cuts[:-1], cuts[1:])):
            block = columns[begin:end] if whole is not None else columns[begin:end, alive]
            partial = partial + q[begin:end] @ block
            if end == dims or len(alive) <= k:
                continue
            rest = np.sqrt((q[end:] ** 2).sum()) * left[b + 1][alive] * (1 + 1e-9) + 1e-6
            low = partial - rest
            bound = np.partition(low, len(low) - k)[len(low) - k]
            stay = partial + rest >= bound
            if stay.sum() < 0.8 * len(alive):
                alive, partial, whole = alive[stay], partial[stay], None
        scores = np.rint(partial).astype(np.int64)
        if len(scores) > k:
            bound = np.partition(scores, len(scores) - k)[len(scores) - k]
            alive, scores = alive[scores >= bound], scores[scores >= bound]
        best = np.lexsort((ids[alive], -scores))[:k]
        yield number, ids[alive][best], scores[best]


def _plain(queries, query_ids, vectors, ids, k):
    many = vectors.astype(object)
    for number, q in enumerate(queries.astype(object)):
        alive = np.flatnonzero(ids != query_ids[number])
        scores = [max(-(1 << 63), min((1 << 63) - 1, int((many[i] * q).sum()) if len(q) else 0)) for i in alive]
        best = sorted(zip(scores, ids[alive].tolist()), key=lambda p: (-p[0], p[1]))[:k]
        yield number, np.array([i for _, i in best], dtype=np.int64), np.array([s for s, _ in best], dtype=np.int64)


def top_k(candidates: DataFrame, queries: DataFrame, k: int, queries_in_block: int = QUERIES_IN_BLOCK, candidates_in_block: int = CANDIDATES_IN_BLOCK) -> DataFrame:
    """The ``k`` candidates with the highest inner product for every query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Both sides have ``id`` and whole-number vectors ``v``. Ties go to the smaller id. A query never meets candidates of its
    own id. With fewer than ``k`` candidates all are given; without any, or without queries, nothing. Vectors of unequal
    length are compared as if filled up with zeros. A candidate row given twice takes two ranks, a query row given twice
    is answered twice. Scores beyond 64 bits end at the limit.
    """
    n_queries, n_candidates = queries.count(), candidates.count()
    query_blocks = max(1, -(-n_queries // queries_in_block))
    candidate_blocks = max(1, -(-n_candidates // candidates_in_block))
    # repeated query rows get numbers of their own
    number = F.row_number().over(Window.partitionBy("id").orderBy("v"))
    own = queries.withColumn("copy", number).withColumn("q", F.pmod(F.xxhash64("id", "copy"), F.lit(query_blocks)).cast("int"))
    left = candidates.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(candidate_blocks)).cast("int").alias("c"),
                             F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    right = own.select("id", "copy", "v", "q", F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1))).alias("c"))
    names = ["query_id", "copy", "vec_id", "score"]

    def cell(many: pa.Table, few: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
        if many.num_rows and few.num_rows:
            dims = max(_longest(many), _longest(few))
            ids, query_ids, copies = many.column("id").to_numpy(), few.column("id").to_numpy(), few.column("copy").to_numpy()
            for n, best, scores in best_in_block(_matrix(few.column("v"), dims), query_ids, _matrix(many.column("v"), dims), ids, k):
                for column, values in zip(out, (np.full(len(best), query_ids[n]), np.full(len(best), copies[n]), best, scores)):
                    column.append(values)
        return pa.table({name: np.concatenate(column).astype(np.int64) for name, column in zip(names, out)})

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(cell, "query_id bigint, copy bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "copy").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
