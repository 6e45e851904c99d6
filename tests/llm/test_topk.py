import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.topk import top_k

TABLE = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in ok if i is not None and i % 100 == 0}:
        found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j is None, j or 0) for j, w in ok if j != i and len(w) == len(v))
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found[:k])]
    return sorted(out, key=str)


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, TABLE).repartition(3)
    return sorted((tuple(r) for r in top_k(frame, F.col("vec_id") % 100 == 0, **options).collect()), key=str)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=8) * rng.choice([0.1, 1, 3])).tolist(), k) for k in range(600)]
    rows += [(600 + k, [1.0] * 8, None) for k in range(200)] + [(900 + k, rows[100][1], None) for k in range(20)]
    assert run(spark, rows, k=10, bucket_rows=64, block_queries=3) == brute(rows, 10)
    assert run(spark, rows, k=10) == brute(rows, 10)


def test_edge_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [float("nan"), 1.0], 1), (400, [float("inf"), 1.0], 1), (None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.0, 0.0], 1),
            (500, [0.0, 0.0], 1), (600, [1.0], 1), (700, [], 1), (3, [-1.0, -5.0], 1), (800, [-3.0, 0.5], 1), (0, [1.0, 2.0], 1), (900, [3e38, -1e30], 1)]
    assert run(spark, rows, k=4) == brute(rows, 4)


def test_no_query_and_empty_table(spark):
    assert run(spark, [(1, [1.0], 1)]) == [] and run(spark, []) == []
