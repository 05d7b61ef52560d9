"""Exact cosine top-k of queries against a bank of unit vectors.

Queries are a stated, small side: they go to the tasks in blocks of bounded bytes, and the bank is scanned once a block.
Each Arrow batch is one matrix product; rows within a hair of a query's k-th best are scored again by a sum from the first
component on, so scores don't depend on blocks or batches. A task keeps k rows a query over its batches and sends those; the
final rank is by score, then reference id, over k rows a task and query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot

QUERY_BLOCK_BYTES = 32 << 20
#: Bytes of a batch of references in double precision, and of its scores against a block of queries.
REFERENCE_BYTES, SCORE_BYTES = 32 << 20, 64 << 20
#: Bytes of query vectors, and pairs of a query and a reference, up to which topk_expression is one plan of a row a pair.
EXPRESSION_BYTES, EXPRESSION_PAIRS = 8 << 20, 1 << 20
#: Products of unit vectors in double precision differ by less than this between summation orders.
HAIR = 1e-9


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(column)
    if n and (len(flat) % n or (width is not None and len(flat) != n * width)):
        raise ValueError("descriptor banks must have equal dimensions")
    return flat.reshape(n, -1) if n else flat.reshape(0, width or 0)


def query_blocks(queries: DataFrame, id_col: str, vector_col: str) -> Iterator[tuple[list, np.ndarray]]:
    """Queries in blocks of bounded bytes: at most a block and a partition are on the driver. A null id is an error."""
    ids, rows, size = [], [], 0
    for r in queries.select(id_col, vector_col).toLocalIterator():
        if r[0] is None:
            raise ValueError(f"a query has no {id_col}")
        ids.append(r[0])
        rows.append(np.asarray(r[1], np.float64))
        size += rows[-1].nbytes
        if size >= QUERY_BLOCK_BYTES:
            yield ids, np.stack(rows)
            ids, rows, size = [], [], 0
    if ids:
        yield ids, np.stack(rows)


def candidates(bank: DataFrame, ids: list, block: np.ndarray, k: int, id_col: str, vector_col: str) -> DataFrame:
    shared = bank.sparkSession.sparkContext.broadcast((ids, block))
    kind = bank.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        bar = np.full(len(ids), -np.inf)  # each query's k-th best so far
        held = None  # query position, reference, score
        rows = max(1, min(REFERENCE_BYTES // (8 * max(queries.shape[1], 1)), SCORE_BYTES // (8 * len(ids))))
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            if batch.column(0).null_count:
                raise ValueError(f"a reference has no {id_col}")
            refs = _matrix(batch.column(1), queries.shape[1])
            names = np.asarray(batch.column(0).to_pylist())
            scores = queries @ refs.T
            n = min(k, len(refs))
            floor = np.maximum(np.partition(scores, len(refs) - n, axis=1)[:, len(refs) - n], bar) - HAIR
            at, to = np.nonzero(scores >= floor[:, None])
            exact = np.zeros(len(at))
            for d in range(queries.shape[1]):
                exact += queries[at, d] * refs[to, d]
            new = (at, names[to], exact)
            at, to, exact = new if held is None else (np.concatenate(c) for c in zip(held, new, strict=True))
            order = np.lexsort((to, -exact, at))
            at, to, exact = at[order], to[order], exact[order]
            first = np.searchsorted(at, np.arange(len(ids)))
            rank = np.arange(len(at)) - first[at]
            keep = rank < k
            held = at[keep], to[keep], exact[keep]
            last = rank == k - 1
            bar[at[last]] = exact[last]
        if held is not None:
            at, to, exact = held
            yield pa.record_batch([pa.array([ids[i] for i in at.tolist()]), pa.array(to.tolist()), pa.array(exact)], names=["query_id", "reference_id", "score"])

    return bank.select(id_col, vector_col).mapInArrow(run, f"query_id {kind}, reference_id {kind}, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "reference_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "reference_id", "rank", "score")


def _found(bank: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """query_id, reference_id, score: what may be among a query's k best."""
    if k < 1:
        raise ValueError("k must be positive")
    found = None
    for ids, block in query_blocks(queries, id_col, vector_col):
        part = candidates(bank, ids, block, k, id_col, vector_col)
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = bank.schema[id_col].dataType.simpleString()
        found = bank.sparkSession.createDataFrame([], f"query_id {kind}, reference_id {kind}, score double")
    return found


def topk(bank: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """query_id, reference_id, rank (from 1), score; k is clamped to the bank by its nature."""
    return _best(_found(bank, queries, k, id_col, vector_col), k)


def _scored(bank: DataFrame, queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """query_id, reference_id, score of all pairs."""
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("q"))
    r = bank.select(F.col(id_col).alias("reference_id"), F.col(vector_col).alias("r"))
    return r.crossJoin(q).select("query_id", "reference_id", dot(F.col("q"), F.col("r")).alias("score"))


def topk_expression(bank: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The same as one Catalyst plan, for narrow vectors, few queries and a small bank: every pair is a row of it.

    Beyond EXPRESSION_PAIRS pairs or EXPRESSION_BYTES of queries (both counted first) pairs are scored in blocks as in topk; only those with a row
    that has no place in a matrix (a null id or vector, another width than most, an element that is null or not finite) stay rows of the plan.
    """
    size = queries.agg(F.sum(F.size(vector_col) * 8 + 16).alias("bytes"), F.count("*").alias("n"), F.mode(F.size(vector_col)).alias("width")).first()
    if (size.bytes or 0) <= EXPRESSION_BYTES and size.n * bank.count() <= EXPRESSION_PAIRS:
        return _best(_scored(bank, F.broadcast(queries), id_col, vector_col), k)
    bad = F.exists(vector_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    odd = F.coalesce(F.col(id_col).isNull() | (F.size(vector_col) != F.lit(size.width)) | bad, F.lit(True))
    found = _found(bank.where(~odd), queries.where(~odd), k, id_col, vector_col)
    for b, q in ((bank.where(odd), queries), (bank.where(~odd), queries.where(odd))):
        if not b.isEmpty() and not q.isEmpty():
            found = found.unionByName(_scored(b, q, id_col, vector_col))
    return _best(found, k)
