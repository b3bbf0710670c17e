import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm.nndescent import nearest_neighbours


def brute(rows, queries, k=10):
    out = {}
    for q in queries:
        d = sorted((math.dist(rows[q], v), i) for i, v in rows.items() if i != q)[:k]
        out[q] = d
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect()
    rows = {i: v.astype(float).tolist() for i, v in enumerate(x)}
    want = brute(rows, range(0, 6000, 100))
    hits = 0
    for q, near in want.items():
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        assert all(r.score == pytest.approx(math.dist(rows[q], rows[r.vec_id]), rel=1e-14) for r in own)
        hits += len({r.vec_id for r in own} & {i for _, i in near})
    assert hits / (10 * len(want)) >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 300, 10)] + [(i, [0.0, float(i)]) for i in range(1, 30)]
    odd = [(400, None), (None, [1.0, 1.0]), (500, [0.0, 0.0]), (600, [1.0, None]), (700, [float("nan"), 1.0]),
           (800, [float("inf"), 1.0]), (900, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<float>").withColumn("node", F.lit(1))
    got = nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect()
    want = brute(dict(rows), [0, 100, 200])
    assert {r.query_id for r in got} == {0, 100, 200}
    for q, near in want.items():
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(r.score, r.vec_id) for r in own] == near


def test_few_rows_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [5.0, 5.0])], "vec_id long, embedding array<float>")
    got = nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got)] == [(0, 1, 1), (0, 2, 2)]
    one = nearest_neighbours(df.where("vec_id = 0"), F.col("vec_id") == 0)
    assert one.count() == 0 and nearest_neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0
