import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality, toxicity
from tessera.llm.textnum import hash_spans, mix, shingles, text_bytes, unique_per_row, words

rng = random.Random(6)
VOCAB = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(2, 9))) for _ in range(400)]
BAD = ["blockhead", "numbskull", "dunderpate"]


def prose(n):
    return " ".join(rng.choices(VOCAB, k=n)) + "."


def test_words_and_hashes():
    texts = ["a b", "", " x\ty\x0bz ", "é é", "b"]
    raw, at = text_bytes(pa.array(texts))
    s, e, r = words(raw, at)
    assert [(raw[a:b].tobytes().decode(), int(k)) for a, b, k in zip(s, e, r)] == [("a", 0), ("b", 0), ("x", 2), ("y", 2), ("z", 2), ("é", 3), ("é", 3), ("b", 4)]
    h = hash_spans(raw, s, e)
    assert h[1] == h[7] and h[5] == h[6] and len(set(h.tolist())) == 6
    code, row = unique_per_row(*shingles(h, r, 5, 2))
    assert np.bincount(row, minlength=5).tolist() == [1, 0, 2, 1, 1]
    x = np.arange(3, dtype=np.uint64)
    assert mix(x)[1] != 1 and x[1] == 1


# -------------------------------------------------------------- quality


def junk(n):
    return rng.choice([lambda: prose(n).upper().replace(" ", "!! "), lambda: " | ".join(prose(n).split()), lambda: "".join(w + rng.choice(["$$$ ", "&&& "]) for w in prose(n).split())])()


def test_quality_held_out(spark):
    rows = [(i, prose(rng.randint(5, 200)) if i % 4 else junk(rng.randint(5, 200)), int(i % 4 > 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    stats = quality.with_statistics(df).withColumnRenamed("id", "doc_id").join(df.select("doc_id", "y"), "doc_id").withColumnRenamed("doc_id", "id")
    model = quality.fit(stats.where("id < 400"))
    got = {r["id"]: r["score"] for r in quality.score(stats.where("id >= 400"), model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows[400:]]) > 0.97
    kept = quality.keep(df.withColumn("score", df.y * 10).withColumn("x", df.y), model)
    assert kept.columns == ["doc_id", "text", "y", "score", "x"]
    assert {r["doc_id"] for r in kept.where("doc_id >= 400").collect()} == {i for i, s in got.items() if s >= 0.5}


def test_statistics_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "x" * 200_000), (5, "🙂"), (None, "a b")]
    got = quality.with_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and all(len(r["x"]) == len(quality.STATISTICS) and np.isfinite(r["x"]).all() for r in got)


@pytest.mark.parametrize("ys, score", [([], 0.5), ([1, 1, None], 1.0), ([0], 0.0)])
def test_quality_without_two_labels(spark, ys, score):
    df = spark.createDataFrame([(i, "a b c", y) for i, y in enumerate(ys)], "doc_id long, text string, y int")
    stats = quality.with_statistics(df).withColumnRenamed("id", "doc_id").join(df.select("doc_id", "y"), "doc_id").withColumnRenamed("doc_id", "id")
    assert quality.fit(stats) == score
    assert all(r["score"] == score for r in quality.score(stats, score).collect())


def test_pool_adjacent_is_isotonic():
    y, w = np.array([0.1, 0.5, 0.3, 0.3, 0.9, 0.8]), np.array([1.0, 1, 2, 1, 1, 3])
    fit = quality.pool_adjacent(y, w)
    assert (np.diff(fit) >= 0).all()
    assert np.isclose((fit * w).sum(), (y * w).sum())
    assert np.allclose(fit, [0.1, 0.35, 0.35, 0.35, 0.825, 0.825])


# ------------------------------------------------------------- toxicity


def test_gradients():
    """Analytic against numeric gradients."""
    net = toxicity.Network(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    raw, at = text_bytes(pa.array([prose(70), prose(20), ""]))
    wd, tri, owner, which, row = toxicity.vocabulary(raw, at)
    idx, of = toxicity.windows(which, row, 3, len(wd))
    y = np.array([1.0, 0, 1, 0])[: len(idx)]
    weight = np.ones(len(idx))

    def loss():
        z = net.forward(net.projected(net.inputs(wd, tri, owner)), idx)
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum() / weight.sum())

    g, _ = net.gradients(wd, tri, owner, idx, y, weight)
    for k, v in net.p.items():
        at_ = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        keep, eps = v[at_], 1e-3
        v[at_] = keep + eps
        up = loss()
        v[at_] = keep - eps
        down = loss()
        v[at_] = keep
        assert abs((up - down) / (2 * eps) - g[k][at_]) < 2e-3 * max(1, abs(g[k][at_])) + 2e-4, k


def test_toxicity_held_out(spark):
    rows = []
    for i in range(700):
        w = prose(rng.randint(5, 300)).split()
        if i % 3 == 0:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    rows += [(900, "x", None), (901, None, 0)]
    df = spark.createDataFrame(rows, "id long, text string, y int")
    net = toxicity.train(df, df.where("id < 500 or id >= 900").select("id", "y"), "id")
    test = spark.createDataFrame([(i, t, "c") for i, t, _ in rows if 500 <= i < 700] + [(1000, None, ""), (1001, "", ""), (1002, prose(20_000), "")], "doc_id long, text string, score string")
    got = {r["id"]: r["score"] for r in toxicity.score(test, net).collect()}
    assert len(got) == 203 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows[500:700]]) > 0.93
    assert got[1000] == got[1001] < 0.5


def test_windows_cover_all_words():
    for n in (0, 1, 63, 64, 65, 96, 97, 500):
        which, row = np.arange(n, dtype=np.int32), np.zeros(n, np.int64)
        idx, of = toxicity.windows(which, row, 1, n)
        assert set(idx[idx < n].tolist()) == set(range(n)) and len(of) == len(idx) >= 1


@pytest.mark.parametrize("ys, score", [([], 0.5), ([1], 1.0)])
def test_toxicity_without_two_labels(spark, ys, score):
    df = spark.createDataFrame([(i, "a", y) for i, y in enumerate(ys)], "id long, text string, y int")
    assert toxicity.train(df, df.select("id", "y"), "id") == score
