"""Exact top-k search by inner product, by exhaustive term-at-a-time accumulation.

A vector is a sparse row of (term, weight). Candidates are dealt into blocks of about ``BLOCK`` rows, queries into blocks
of about ``QUERY_BLOCK``, and every candidate block meets every query block in a group of its own. A group turns its
candidates into postings (for every term, the rows that have it and their weights). Each term of the queries scatters
its weighted postings into a dense array of scores, a row for each query; partition selection then takes each query's
k best of the block. Blocks' winners are merged by a window whose partial limit runs before the shuffle.

The stated query set meets all rows, so that the work is queries x rows. What is shuffled is (rows x query blocks) +
(queries x candidate blocks) vectors and k winners for each query and candidate block, never a score for each pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Candidates and queries in a block, and queries whose scores are held at a time.
BLOCK, QUERY_BLOCK, QUERIES_AT_ONCE = 4096, 2048, 32
#: Up to this bound on a score, weights are added up in 64 bits; beyond it as Python's unbounded integers.
SAFE = 2**62
LONG = 2**63 - 1
FOUND = "query_row long, query_id long, row long, id long, score long"


def valid_vector(vector: Column) -> Column:
    """Whether the vector is there and all its components are there and finite."""
    return F.coalesce(F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) != F.lit(float("inf"))), F.lit(False))), F.lit(False))


def _terms(vectors: pa.ChunkedArray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of all components whose weight, floor(scale * x), is not zero."""
    lists = vectors.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if len(x) and np.abs(x).max() >= 2**40:  # as integers of any size
        weight = np.array([int(v) * scale if abs(v) >= 2**53 else math.floor(v * scale) for v in x.tolist()], object)
    else:
        weight = np.floor(x * scale).astype(np.int64)
    some = weight != 0
    return row[some], term[some], weight[some]


def _by_term(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    cuts = np.flatnonzero(np.diff(term)) + 1
    return {int(t[0]): (r, w) for r, t, w in zip(np.split(row, cuts), np.split(term, cuts), np.split(weight, cuts)) if len(t)}


def _accumulate(queries: dict, postings: dict, n_queries: int, n_rows: int, kind) -> np.ndarray:
    """Scores, a row for each query: term by term, weighted postings are scattered into the dense array."""
    scores = np.zeros((n_queries, n_rows), kind)
    for term, (q, qw) in queries.items():
        if term in postings:
            rows, w = postings[term]
            if 2 * len(rows) > n_rows:
                dense = np.zeros(n_rows, kind)
                dense[rows] = w
                scores[q] += np.multiply.outer(qw, dense)
            else:
                scores[np.ix_(q, rows)] += np.multiply.outer(qw, w)
    return scores if kind is np.int64 else np.clip(scores, -LONG, LONG).astype(np.int64)


def _select(scores: np.ndarray, own: int | None, k: int) -> np.ndarray:
    """Positions of the k largest scores but the own one; among equal scores, those that come first."""
    if own is not None:
        scores = np.delete(scores, own)
    k = min(k, len(scores))
    if not k:
        return np.empty(0, np.int64)
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    at = np.concatenate((above, np.flatnonzero(scores == least)[: k - len(above)]))
    return at if own is None else at + (at >= own)


def _block_search(k: int, scale: int):
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return schema.empty_table()
        # in order of id: then the first of equal scores are those with the smallest ids
        candidates = candidates.sort_by([("id", "ascending"), ("row", "ascending")])
        rows, ids = candidates["row"].to_numpy(), candidates["id"]
        place = {r: i for i, r in enumerate(rows.tolist())}
        row, term, weight = _terms(candidates["vector"], scale)
        q_row, q_term, q_weight = _terms(queries["vector"], scale)
        widest = int(max(np.bincount(row).max(initial=0), np.bincount(q_row).max(initial=0)))
        bound = widest * int(np.abs(weight).max(initial=0)) * int(np.abs(q_weight).max(initial=0))
        kind = np.int64 if bound < SAFE and weight.dtype == q_weight.dtype == np.int64 else object
        postings = _by_term(row, term, weight.astype(kind))
        q_rows, q_ids = queries["row"].to_pylist(), queries["id"].to_pylist()
        found: list[tuple[int, np.ndarray, list[int]]] = []
        for at in range(0, len(q_rows), QUERIES_AT_ONCE):
            mine = (q_row >= at) & (q_row < at + QUERIES_AT_ONCE)
            terms = _by_term(q_row[mine] - at, q_term[mine], q_weight[mine].astype(kind))
            some = len(q_rows[at:at + QUERIES_AT_ONCE])
            for i, scores in enumerate(_accumulate(terms, postings, some, len(rows), kind)):
                best = _select(scores, place.get(q_rows[at + i]), k)
                found.append((at + i, best, scores[best].tolist()))
        at = np.concatenate([b for _, b, _ in found] or [np.empty(0, np.int64)])
        return pa.Table.from_arrays([
            pa.array([q_rows[q] for q, b, _ in found for _ in b], pa.int64()), pa.array([q_ids[q] for q, b, _ in found for _ in b], pa.int64()),
            pa.array(rows[at], pa.int64()), ids.take(pa.array(at)).combine_chunks(), pa.array([s for _, _, x in found for s in x], pa.int64())], schema=schema)

    return search


def _dealt(rows: DataFrame, n: int, size: int, name: str) -> tuple[DataFrame, int]:
    blocks = max(1, -(-n // size))
    return rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), blocks


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Columns query_id, rank (from 1), ``id_col`` and score: for each row where ``is_query`` holds, the ``k`` other rows
    with the highest inner product of floor(``scale`` * x), ties to the smaller id (null ids last).

    Vectors that are null or hold a null or non-finite component take no part. Vectors may differ in length: a missing
    component is zero, an empty vector scores 0 with all. A row is left out of its own results only; rows that repeat its
    id or its vector are candidates. Scores beyond a long are cut to its ends
    before they are ranked. Extra columns are not read. An empty table, or no query, gives no rows.
    """
    rows = materialise(vectors.where(valid_vector(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("row")))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    candidates, blocks = _dealt(rows.select("id", "vector", "row"), counts["n"], BLOCK, "block")
    queries, query_blocks = _dealt(rows.where("asks").select("id", "vector", "row"), counts["q"], QUERY_BLOCK, "query_block")
    meet = ["block", "query_block"]
    candidates = candidates.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = candidates.groupBy(*meet).cogroup(queries.groupBy(*meet)).applyInArrow(_block_search(k, scale), FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
