"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A vector's components become integers, floor(scale * x); component t is term t. The
vectors are candidates, cut into blocks by a hash of their id, and every block meets
every block of queries (one block of queries unless there are very many). In a cell
the candidates form an inverted index: for each term, the postings of its non-zero
weights. Each group of query rows scatters weight * posting into dense score arrays,
term by term; every candidate of the block has a score, zero included. A partition
selection keeps a cell's best k a query and a ranked merge the best over all blocks.

Equal rows are counted first and searched as one, so blocks of ``block_rows`` distinct
rows are bounded; ids that repeat are dealt by vector as well.
Rows take no part if the id or vector is null, or a component is null or not finite.
A query never meets itself: of rows equal to it in id and vector one is left out.
Vectors of different lengths meet on the terms both have; an empty one scores zero.
Ties go to the smaller vec_id. Repeated rows are all candidates; repeated query rows
return one answer, or one each with ``each_row``. An empty table, or one with no query, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logarbor.llm.tools import written

SCALE = 256
BLOCK_ROWS = 4096      # candidates in a block, about
QUERY_ROWS = 8192      # queries in a block, about
TOGETHER = 64          # score arrays filled at once
DENSE = 0.5            # postings that hold more of the block are kept as a full array


def integer_vectors(vectors: DataFrame, *, scale: int = SCALE, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows that take part, components as floor(scale * x) with x as double."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return (vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
            .select(F.col(id_col).cast("bigint").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v")))


class Postings:
    """Inverted index of a block: for each term the candidates that hold it and their weights."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.n = len(rows)
        terms = max((len(r) for r in rows), default=0)
        dense = np.zeros((terms, self.n), dtype=np.int64)
        for i, r in enumerate(rows):
            dense[:len(r), i] = r
        self.largest = int(np.abs(dense).max(initial=0))
        self.lists = []
        for weights in dense:
            at = np.flatnonzero(weights)
            self.lists.append((None, weights.copy()) if len(at) > DENSE * self.n else (at, weights[at]))

    def accumulate(self, queries: list[np.ndarray]) -> np.ndarray:
        """Dense score array of each query, filled a term at a time."""
        terms = min(len(self.lists), max((len(q) for q in queries), default=0))
        weights = np.zeros((len(queries), terms), dtype=np.int64)
        for i, q in enumerate(queries):
            weights[i, :min(terms, len(q))] = q[:terms]
        fits = terms * self.largest * int(np.abs(weights).max(initial=0)) < 2**31
        kind = np.int32 if fits else np.int64
        scores = np.zeros((len(queries), self.n), dtype=kind)
        for t in range(terms):
            rows = np.flatnonzero(weights[:, t])  # a query without the term skips its postings
            at, values = self.lists[t]
            if not len(rows) or not len(values):
                continue
            add = weights[rows, t].astype(kind)[:, None] * values.astype(kind)[None, :]
            if at is None and len(rows) == len(queries):
                scores += add
            elif at is None:
                scores[rows] += add
            else:
                scores[rows[:, None], at[None, :]] += add
        return scores


def block_top(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k distinct candidates of one cell for each query, with their copies, k at most."""
    candidates = candidates.sort_values("vec_id", kind="stable")
    ids = candidates["vec_id"].to_numpy(np.int64)
    own = [np.asarray(v, dtype=np.int64) for v in candidates["v"]]
    copies = candidates["copies"].to_numpy(np.int64)
    postings = Postings(own)
    asked = [np.asarray(v, dtype=np.int64) for v in queries["v"]]
    out = []
    for start in range(0, len(queries), TOGETHER):
        part = asked[start:start + TOGETHER]
        scores = postings.accumulate(part)
        keys = queries[["vec_id", "q", "copies"]].iloc[start:start + TOGETHER].itertuples(index=False)
        for (query_id, q, asked_by), vector, row in zip(keys, part, scores):
            there = np.minimum(copies, k)
            lo, hi = np.searchsorted(ids, [query_id, query_id + 1])
            for i in range(lo, hi):  # its own row
                if np.array_equal(own[i], vector):
                    there[i] = min(copies[i] - 1, k)
                    break
            left = np.flatnonzero(there)
            if not len(left):
                continue
            points = row[left]
            if len(left) > k:  # partition selection: all that reach the k-th best score, then by id
                kth = np.partition(points, len(points) - k)[len(points) - k]
                above, equal = left[points > kth], left[points == kth]
                left = np.concatenate((above, equal[:k - len(above)]))  # ids ascend
            out += [(int(query_id), int(q), int(asked_by), int(ids[i]), int(row[i]), int(there[i])) for i in left]
    return pd.DataFrame(out, columns=["query_id", "q", "asked_by", "vec_id", "score", "there"]).astype("int64")


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, block_rows: int = BLOCK_ROWS,
          query_rows: int = QUERY_ROWS, each_row: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score of every query's best k; ``vectors`` as from ``integer_vectors``."""
    rows = written(vectors.groupBy("vec_id", "v").agg(F.count("*").alias("copies")))
    n, asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-asked // query_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    times = lambda c: F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(c)))
    key = F.xxhash64("vec_id", "v")
    deal = lambda m: F.pmod(key, F.lit(m)).cast("int")
    candidates = rows.withColumn("block", deal(blocks)).withColumn("part", every(groups))
    # columns of their own, as both sides of the cogroup read one table
    queries = (rows.where(is_query).select(*(F.col(c).alias(c) for c in rows.columns))
               .withColumn("q", key).withColumn("part", deal(groups))
               .withColumn("block", every(blocks)))

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return block_top(q, c, k)

    best = (queries.groupBy("part", "block").cogroup(candidates.groupBy("part", "block"))
            .applyInPandas(cell, "query_id bigint, q bigint, asked_by bigint, vec_id bigint, score bigint, there bigint"))
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    ranked = (best.withColumn("copy", times("there")).withColumn("rank", F.row_number().over(order))
              .where(F.col("rank") <= k))
    if each_row:
        ranked = ranked.withColumn("answer", times("asked_by"))
    return ranked.select("query_id", "rank", "vec_id", "score")
