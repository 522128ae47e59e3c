"""Exact top-k search against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillboard.llm import topk_norm


def expected(rows, k, every):
    usable = [(p, i, [math.floor(256 * float(x)) for x in v]) for p, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for p, i, v in usable:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for r, j, w in usable if r != p and len(w) == len(v))
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def search(spark, rows, k=5, every=5, **how):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, score int").repartition(3)
    return sorted(tuple(r) for r in topk_norm.top_k(df, F.col("vec_id") % every == 0, k=k, **how).collect())


def clustered(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    vectors = centres[rng.integers(0, 6, n)] + 0.2 * rng.normal(size=(n, dim))
    return [(i, [float(x) for x in np.float32(v * (1 + spread * rng.exponential()))]) for i, v in enumerate(vectors)]


@pytest.mark.parametrize(("spread", "how"), [(0.0, {}), (3.0, {}), (1.0, {"bucket_rows": 7, "switch": 0.9, "sample_rows": 20}), (0.0, {"bucket_rows": 16, "switch": -1.0, "focus": 2, "block_queries": 9})])
def test_equals_all_products(spark, spread, how):
    rows = clustered(1, 300, 16, spread)
    assert search(spark, rows, **how) == expected(rows, 5, 5)


def test_copies_ties_zero_and_odd_vectors(spark):
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (45, [-1.0, 0.0, 0.0]), (46, None), (50, [1.0, None, 1.0]), (51, [float("nan"), 0.0, 0.0]), (55, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (60, [1.0, 2.0]), (65, []), (70, [3.0] * 4), (71, [2.0] * 4)]
    assert search(spark, rows, bucket_rows=8) == expected(rows, 5, 5)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5])]
    assert search(spark, rows) == sorted([(0, 1, 0, 65536), (0, 2, 1, 32768)] * 2)


def test_very_large_components_stay_exact(spark):
    rows = [(0, [3e5, 1.0]), (1, [3e5, 2.0]), (2, [-3e5, 1.0]), (3, [1e30, 1.0])]
    out = search(spark, rows[:3])
    assert out == expected(rows[:3], 5, 5)
    assert search(spark, rows)[0][:3] == (0, 1, 3)  # cut to the nearest long


def test_no_queries_and_nothing(spark):
    assert search(spark, [(1, [1.0])]) == [] and search(spark, []) == [] and search(spark, [(5, [1.0])]) == []
