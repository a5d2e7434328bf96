import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hardneg, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, is_anchor, cfg):
    """Every product, sorted; ``rows`` are (id, vector, label)."""
    use = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        c = [math.floor(x * cfg.scale) for x in v]
        if max(map(abs, c), default=0) < hardneg.LIMIT:
            use.append((i, c, label))
    out = []
    for n, (i, q, label) in enumerate(use):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(map(int.__mul__, q, c)), j, m, other) for m, (j, c, other) in enumerate(use) if m != n and len(c) == len(q))
        for ps, pid, *_ in [s for s in scored if s[3] == label][: cfg.positives]:
            ps = -ps
            fits = [s for s in scored if s[3] != label and cfg.least * ps <= -100 * s[0] <= cfg.most * ps]
            out += [(i, pid, r, s[1], ps, -s[0]) for r, s in enumerate(fits[: cfg.negatives], 1)]
    return sorted(out)


def run(spark, rows, cfg=hardneg.HardConfig(), mod=10, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(map(tuple, hardneg.hard_negatives(df, F.col("vec_id") % mod == 0, cfg).collect()))


def vectors(n, d, seed, labels=3, spread=0.2):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(d)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize(
    "cfg", [hardneg.HardConfig(), hardneg.HardConfig(anchor_rows=7, cell_rows=40), hardneg.HardConfig(2, 3, 10, 100, 16.0), hardneg.HardConfig(3, 4, scale=1e5)]
)
def test_equals_brute_force(spark, cfg):
    rows = vectors(500, 12, 1)
    got = run(spark, rows, cfg)
    assert got and got == brute(rows, lambda i: i % 10 == 0, cfg)


def test_ties_and_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(60), [float(rng.randrange(-1, 3)) for _ in range(4)], rng.randrange(2)) for _ in range(300)]
    rows += [rows[5]] * 40 + [(10, [1.0, 1.0, 1.0, 1.0], 0)] * 30 + [(11, [1.0, 1.0, 1.0, 0.0], 1)] * 30
    cfg = hardneg.HardConfig(anchor_rows=16, cell_rows=64)
    assert run(spark, rows, cfg, 5) == brute(rows, lambda i: i % 5 == 0, cfg)


def test_rows_that_take_no_part(spark):
    rows = vectors(120, 6, 8)
    rows += [(200, None, 1), (210, [None] + [0.1] * 5, 1), (220, [math.nan] + [0.1] * 5, 1), (230, [math.inf] + [0.1] * 5, 1), (240, [0.2] * 6, None)]
    rows += [(None, [0.2] * 6, 1), (250, [1e9] + [0.1] * 5, 1), (260, [], 1), (261, [], 1), (262, [], 2), (270, [0.3] * 3, 0), (271, [0.3] * 3, 0), (272, [0.2] * 3, 1), (280, [0.0] * 6, 1)]
    got = run(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0, hardneg.HardConfig())
    assert {r[0] for r in got} >= {260, 270} and not {r[0] for r in got} & {200, 210, 220, 230, 240, 250}


def test_empty_and_without_partners(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [0.5], 1)]) == []
    assert run(spark, [(0, [0.5], 1), (1, [0.5], 1)]) == []
    assert run(spark, [(k, [0.5], 1) for k in range(1, 9)]) == []


def test_clashing_names(spark):
    rows = vectors(80, 5, 2)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", row int, a string, v int")
    got = sorted(map(tuple, hardneg.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0, hardneg.HardConfig())


@pytest.mark.parametrize("size", [3, 200, 1 << 20])
def test_slices_equal_products(size):
    rng = np.random.default_rng(size)
    q, v = rng.integers(-size, size, (50, 9)), rng.integers(-size, size, (300, 9))
    want = q @ v.T
    least, most = np.quantile(want, 0.9, axis=1).astype(np.int64), np.quantile(want, 0.97, axis=1).astype(np.int64)
    i, j, s = hardneg.within(q, v, least, most)
    inside = (want >= least[:, None]) & (want <= most[:, None])
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(inside)), strict=True))
    assert (s == want[i, j]).all()


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL["op13_hard_negatives"])
    got = queries.QUERIES["op13_hard_negatives"](spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
