import math

import numpy as np
from pyspark.sql import functions as F

from listprep.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, norm string, block string, x string"


def brute(rows, k, chosen):
    vectors = {}
    for vec_id, e in rows:
        if vec_id is None or e is None or any(v is None or not math.isfinite(v) for v in e):
            continue
        own = [math.floor(256 * float(np.float32(v))) for v in e]
        vectors[vec_id] = min(vectors.get(vec_id, own), own)
    out = []
    for q in filter(chosen, vectors):
        scored = [(-sum(a * b for a, b in zip(vectors[q], v)), c) for c, v in vectors.items() if c != q]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def search(spark, rows, k=5, step=10):
    df = spark.createDataFrame([(i, e, 0, "n", "b", "x") for i, e in rows], SCHEMA)
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % step == 0, k).collect()))


def test_scores_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERIES", 12)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.1, 1, 3])).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[5][1]) for i in range(400, 520)]  # many equal vectors, many ties
    assert search(spark, rows) == brute(rows, 5, lambda i: i % 10 == 0)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (10, [0.5, -1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
            (None, [9.0, 9.0]), (5, [1.0]), (6, []), (10, [0.5, -2.0]), (0, [1.0, 2.0])]
    assert search(spark, rows) == brute(rows, 5, lambda i: i % 10 == 0)


def test_few_or_no_candidates(spark):
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, []) == []
    assert search(spark, [(0, [0.0]), (1, [0.0])]) == [(0, 1, 1, 0)]
