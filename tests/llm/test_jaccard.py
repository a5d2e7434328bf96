import random
import re

import numpy as np
import pytest

from tessera.llm import jaccard
from tessera.llm.jaccard import jaccard_components


def shingles(text, k=5):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=150, longest=400):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=40)
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:  # an edited copy of an earlier text
            w = rng.choice(rows)[1].split() or ["a"]
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                p = rng.randrange(len(w))
                w[p : p + 1] = rng.choice([[], [rng.choice(vocab)], [w[p].upper(), rng.choice(vocab)]])
        else:
            w = rng.choices(vocab, k=rng.choice([0, 1, 3, 4, 5, 6, 8, 9, 12, 20, 40, 100, longest]))
            if kind > 0.8:
                w += passage
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "a b c"), (1004, "A  b C"), (1005, "a\x0bb\x1fc")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, component_id string, n long")
    assert sorted(tuple(r) for r in jaccard_components(df).collect()) == brute(rows)


def test_group_at_the_threshold(spark):
    """A chain in which a bucket's first document does not link with all others."""
    rng = random.Random(5)
    w = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(w)))
        w = list(w)
        w[rng.randrange(len(w))] = f"n{i}"
        w[rng.randrange(len(w))] = f"m{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_components(df).collect()) == brute(rows)


def test_repeated_rows_and_null_id(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((-1 if r[0] is None else r[0]), r[1], r[2]) for r in jaccard_components(df).collect())
    assert got == [(-1, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_very_long_text(spark):
    rng = random.Random(9)
    w = rng.choices([f"w{i}" for i in range(5000)], k=60_000)
    v = list(w)
    for _ in range(1000):
        v[rng.randrange(len(v))] = "x"
    rows = [(1, " ".join(w)), (2, " ".join(v)), (3, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_components(df).collect()) == brute(rows)


def test_family_of_copies_in_one_bucket(spark):
    """Copies of one text with few to many edits, some of them shared by sub-families: buckets are dealt again."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    families = [[(rng.randrange(150), f"f{k}_{j}") for j in range(rng.randint(1, 3))] for k in range(8)]
    rows = []
    for i in range(160):
        w = list(base)
        for p, x in families[i % 8] if i % 3 else []:
            w[p] = x
        for j in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
            w[rng.randrange(150)] = f"e{i}_{j}"
        rows.append((i * 7 % 160, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_components(df).collect()) == brute(rows)


def test_sets_of_thousands_at_the_threshold(spark):
    """Pairs just at and just below 80 per cent, of sets with 5,000 shingles."""
    rng = random.Random(2)
    rows = []
    for k in range(12):
        w = [f"t{k}_{i}" for i in range(5004)]
        v = list(w)
        # a changed word far from others takes 5 of 5,000 shingles; 111 leave 4445 of 5555, 112 leave fewer than 80 per cent
        for p in rng.sample(range(1000), 111 + k % 2):
            v[p * 5 + 4] = "x"
        rng.shuffle(v) if k == 11 else None
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_components(df).collect()) == brute(rows)


def test_rows_of_one_id_with_different_texts(spark):
    """An id that is a copy in one row and linked to another document in the next is one vertex."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, a), (2, b), (3, b + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["id"], r["component_id"]) for r in jaccard_components(df).collect()) == [(1, 1), (2, 1), (2, 1), (3, 1)]


def test_sets_are_picked_and_sketched_in_one_python_worker(spark):
    rows = [(i, sorted(hash((i, j)) for j in range(20 * i))) for i in range(5)]
    sets = spark.createDataFrame(rows, "id long, set array<long>")
    ids = sets.where("id <> 3").select("id")
    wide = jaccard._picked(sets, ids, jaccard._wide_sketch, "id long, n long, wide binary")
    assert wide._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r["id"]: (r["n"], bytes(r["wide"])) for r in wide.collect()}
    assert set(got) == {0, 1, 2, 4}
    for i, own in rows:
        size = 4 << max(1, len(own)).bit_length()
        odd = np.zeros(size, np.uint8)
        for h in own:
            odd[((h % 2**64) >> 8) % size] ^= 1
        assert i == 3 or got[i] == (len(own), np.packbits(odd).tobytes())
