import math

import numpy as np
import pytest

from tessera.llm.neardup import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, rep int"


def brute(rows, cosine=0.93):
    def unit(v):
        if v is None or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        a = np.array(v, np.float32).astype(float)
        return a / math.sqrt(a @ a)

    u = [unit(r[1]) if r[2] is not None else None for r in rows]
    n = len(rows)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j and u[i] is not None and u[j] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine:
                links[i] += 1
                parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(n))


def make(n, d, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    for i in range(0, n - 3, 5):
        base[i + 1] = base[i] + rng.normal(size=d) * rng.uniform(0.05, 0.5)
        base[i + 2] = base[i]
    return [(i, [float(np.float32(v)) for v in base[i]], i % 2 if i % 11 else None, "x", 1) for i in range(n)]


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in near_duplicates(df, **how).collect())


def test_against_brute_force(spark):
    rows = make(300, 16, 1)
    rows += [(900, None, 0, "", 0), (901, [0.0] * 16, 0, "", 0), (902, [float("nan")] + [1.0] * 15, 0, "", 0), (903, [None] + [1.0] * 15, 0, "", 0), (904, [1.0, 2.0], 0, "", 0), (905, [2.0, 4.0], 0, "", 0), (906, [], 0, "", 0)]
    assert run(spark, rows) == brute(rows)


def test_forest_and_blocks_lose_nothing(spark):
    rows = make(400, 32, 2)
    assert run(spark, rows, leaf_rows=64, block_rows=16, trees=14) == brute(rows)


def test_dense_group_counts_once(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=24)
    rows = [(i, [float(np.float32(v)) for v in centre + rng.normal(size=24) * 0.1], 1, "", 0) for i in range(120)]
    assert run(spark, rows, leaf_rows=16, block_rows=50) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("n", [1, 2])
def test_tiny(spark, n):
    rows = [(i, [1.0, 2.0], 0, "", 0) for i in range(n)]
    assert run(spark, rows) == brute(rows)
