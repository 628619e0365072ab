import random

import duckdb
import numpy as np
import pytest
from logarbor.llm import hard_negatives as hn
from logarbor.llm.queries import ORACLE, op13_angular_hard_negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute_force(rows, low=80, high=100, k=5):
    kept = {(i, y, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v, y in rows
            if i is not None and y is not None and v is not None
            and all(x is not None and np.isfinite(np.float32(x)) for x in v)}
    out = []
    for a in kept:
        if a[0] % 100:
            continue
        score = {x: sum(p * q for p, q in zip(a[2], x[2])) for x in kept if x != a}
        order = sorted(score, key=lambda x: (-score[x], x[0]))
        for p in [x for x in order if x[1] == a[1]][:k]:
            s = score[p]
            inside = [x for x in order if x[1] != a[1] and low * s <= 100 * score[x] <= high * s][:k]
            out += [(a[0], p[0], r, x[0], s, score[x]) for r, x in enumerate(inside, 1)]
    return sorted(out)


def mined(df, **options):
    got = hn.hard_negatives(hn.labelled_vectors(df, F.col("label")), F.col("vec_id") % 100 == 0, **options)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                               "negative_score").collect())


def table(seed=1, n=400, dims=12, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, spread) for x in c], rng.randrange(3)))
    return rows


ODD = [(None, [1.0] * 12, 1), (1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")], 1),
       (1003, [float("inf"), 1.0], 2), (1004, [1.0] * 12, None), (1005, [], 1), (1100, [], 1), (1006, [0.0] * 12, 2),
       (1200, [0.0] * 12, 2), (1007, [2.0, -1.0], 0), (1300, [0.5, 0.5, 0.5], 0), (1400, [-3.0] * 12, 1),
       (1400, [-3.0] * 12, 1), (1400, [-3.0] * 12, 2), (1500, [3e4] * 12, 1), (1501, [2.9e4] * 12, 1), (1502, [2.8e4] * 12, 0)]


@pytest.mark.parametrize("options", [{}, {"block_rows": 60, "anchor_rows": 2}, {"references": 1}])
def test_equals_brute_force(spark, options):
    rows = table() + ODD + table(2, 40)  # some ids a second time with other vectors
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "v", "block", "part", "positive", "rank", "anchor_id", "windows"):
        df = df.withColumn(name, F.lit("clash"))
    want = brute_force(rows)
    assert len(want) > 50 and mined(df, **options) == want


def test_a_hot_vector_and_ties(spark):
    rows = table(4, 150) + [(i, [1.0] * 12, i % 2) for i in range(200, 320)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df, block_rows=50) == brute_force(rows)


def test_empty_tables(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 1)], SCHEMA)) == []


def test_query_equals_its_sql(spark, tmp_path):
    df = spark.createDataFrame(table(6, 500, 8) + ODD, SCHEMA)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    query = op13_angular_hard_negatives(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    cur = con.execute(ORACLE["op13_angular_hard_negatives"])
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, query.select(*names).collect())) == sorted(cur.fetchall())


def test_bounds_hold_and_cut():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 16))
    x = np.floor(256 * (centres[rng.integers(0, 5, 300)] + 0.05 * rng.normal(size=(300, 16)))).astype(np.int64)
    x = np.vstack([x, np.zeros((1, 16), np.int64), x[:1] * 40, -x[:1]])
    towards = hn.reference_directions(list(x), 8)
    norms, angles = hn.angles_to(x, towards)
    low, high = hn.score_bounds(norms, angles, norms, angles)
    scores = x @ x.T
    assert (low <= scores).all() and (scores <= high).all()
    decided = (high < 0.8 * scores.max(axis=1)[:, None]) | (low > scores.max(axis=1)[:, None])
    assert decided.mean() > 0.5  # clustered vectors: most rows need no integer score
