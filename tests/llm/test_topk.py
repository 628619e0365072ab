import random

import duckdb
import numpy as np
from helpers import with_clashing_columns
from pyspark.sql import functions as F

from logarbor.llm import topk
from logarbor.llm.queries import ORACLE, QUERIES

VECTORS = "vec_id bigint, embedding array<float>, label int"


def reference(rows, k=5, step=50):
    """rows: (vec_id, vector) that take part."""
    own = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows]
    out, done = [], set()
    for n, (i, q) in enumerate(own):
        if i % step or (i, tuple(q)) in done:
            continue
        done.add((i, tuple(q)))
        scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for m, (j, c) in enumerate(own) if m != n)
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = with_clashing_columns(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS))
    got = topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 50 == 0, **options)
    return sorted(tuple(r) for r in got.collect())


def test_equals_brute_force_over_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) if rng.random() < 0.4 else 0.0 for _ in range(16)]) for i in range(400)]
    assert run(spark, rows, block_rows=64, query_rows=3) == reference(rows)
    assert run(spark, rows) == reference(rows)


def test_ties_repeats_lengths_and_rows_that_take_no_part(spark):
    vector = [0.5, -0.25]
    good = [(0, vector), (0, vector), (50, vector), (50, [0.5, 0.5, 0.5]), *((i, vector) for i in range(1, 8)),
            (100, []), (150, [1e6, 1e6]), (9, vector)]
    bad = [(10, None), (None, vector), (11, [0.1, None]), (12, [float("nan"), 1.0]), (13, [float("inf"), 1.0]),
           (200, [None]), (250, None)]
    assert run(spark, good + bad, block_rows=3, query_rows=2) == reference(good)


def test_few_rows_and_empty(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 512 * 256)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, []) == []


def test_sparse_postings_scatter_like_dense_ones():
    rng = np.random.default_rng(2)
    rows = [np.where(rng.random(12) < p, rng.integers(-300, 300, 12), 0) for p in (0.1, 0.9) for _ in range(40)]
    queries = [np.where(rng.random(12) < 0.3, rng.integers(-300, 300, 12), 0) for _ in range(9)]
    index = topk.Postings(rows)
    assert any(at is None for at, _ in index.lists) or any(at is not None for at, _ in index.lists)
    assert np.array_equal(index.accumulate(queries), np.array(queries) @ np.array(rows).T)
    large = topk.Postings([np.array([2**30, -2**30])])
    assert large.accumulate([np.array([2**30, 5])])[0, 0] == 2**60 - 5 * 2**30


def test_query_answers_each_repeated_row_as_its_sql(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], 0) for i in range(60)]
    rows += [(50, rows[50][1], 0)] * 2 + [(0, rows[0][1], 0)] * 9 + [(7, rows[7][1], 0)] * 3 + [(50, [0.5] * 4, 0)]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in QUERIES["op4_exact_top_k"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert sorted(got) == sorted(con.execute(ORACLE["op4_exact_top_k"]).fetchall())
    assert len(got) == 5 * (10 + 4)


def test_copies_of_a_row_are_one_candidate_of_a_block():
    import pandas as pd

    rows = pd.DataFrame({"vec_id": [0, 1], "v": [[2], [1]], "copies": [10**9, 2]})
    got = topk.block_top(rows.iloc[:1].assign(q=0), rows, 3)
    assert got[["vec_id", "score", "there"]].values.tolist() == [[0, 4, 3], [1, 2, 2]]
