import random

import numpy as np
import pytest

from tessera.llm.suffixes import repeated_passages


def brute(rows, n=50):
    """Words of each document that lie in a passage of n words that another document has."""
    words = {}
    for d, t in rows:
        if d is not None:
            words.setdefault(d, []).append((t or "").split())
    owners = {}
    for d, texts in words.items():
        for w in texts:
            for k in range(len(w) - n + 1):
                owners.setdefault(tuple(w[k : k + n]), set()).add(d)
    out = set()
    for d, texts in words.items():
        for w in texts:
            for k in range(len(w) - n + 1):
                if len(owners[tuple(w[k : k + n])]) > 1:
                    out.update((d, p) for p in range(k, k + n))
    return out


def covered(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, other_id string, g int")
    return {(r["id"], p) for r in repeated_passages(df, **how).collect() for p in range(r["start_word"], r["end_word"])}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    passages = [rng.choices(vocab, k=rng.choice([49, 50, 51, 60, 90, 200])) for _ in range(8)]
    rows = []
    for i in range(80):
        w = rng.choices(vocab, k=rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (None, rows[5][1])]
    rows += [(110, "for " * 300), (111, "x for " * 90), (112, "y " + "for " * 120), (113, "one two three " * 60), (114, "one two three " * 40)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert covered(spark, rows) == brute(rows)


def test_every_planted_passage_is_found(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(2000)]
    rows, planted = [], []
    for i in range(60):
        rows.append((i, rng.choices(vocab, k=120)))
    for k in range(20):
        p = rng.choices(vocab, k=50 + k)
        for d in rng.sample(range(60), 2):
            rows[d][1].extend(p)
            planted.append((d, len(rows[d][1]) - len(p), len(rows[d][1])))
    got = covered(spark, [(i, " ".join(w)) for i, w in rows])
    for d, a, b in planted:
        assert all((d, p) in got for p in range(a, b))


def test_hot_passage_in_parts(spark):
    rng = random.Random(2)
    p = " ".join(rng.choices([f"w{i}" for i in range(500)], k=70))
    rows = [(i, f"a{i} b{i} {p} c{i}") for i in range(300)]
    got = covered(spark, rows, group_rows=50)
    assert got == {(i, k) for i in range(300) for k in range(2, 72)}


def test_rare_passages_around_a_hot_gram(spark):
    """Pairs share 50 words each, whose only anchor may be a gram that all 240 documents have."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    hot = rng.choices(vocab, k=34)
    rows = []
    for k in range(120):
        p = " ".join(rng.choices(vocab, k=8) + hot + rng.choices(vocab, k=8))
        rows += [(2 * k, f"x{k} {p} y{k}"), (2 * k + 1, f"z{k} {p}")]
    assert covered(spark, rows, group_rows=20) == {(d, p) for d in range(240) for p in range(1, 51)}


@pytest.mark.parametrize("seed", [1, 4])
def test_nothing_is_missed(spark, seed):
    """Runs of one word up to their edges, and passages whose two sides other documents match longer."""
    rng = random.Random(seed)
    rows = corpus(seed) + [(120, "q " + "for " * 77 + "r " * 60), (121, "s t " + "for " * 77 + "r " * 55), (122, "for " * 50), (123, "u " + "for " * 51 + "v")]
    vocab = [f"v{i}" for i in range(4000)]
    for k in range(40):
        left, mid, right = rng.choices(vocab, k=15), rng.choices(vocab, k=20), rng.choices(vocab, k=15)
        texts = [left + mid + right, left + mid + right, left + mid + right[:5], left[5:] + mid + right]
        texts += [rng.choices(vocab, k=40) + left[-d:] + mid + right + rng.choices(vocab, k=d) for d in (1, 2, 3)]
        rows += [(1000 + 10 * k + i, " ".join([*rng.choices(vocab, k=3), *t, *rng.choices(vocab, k=3)])) for i, t in enumerate(texts)]
    assert covered(spark, rows) == brute(rows)


def test_near_copies_of_one_text(spark):
    """Many copies with edits of their own: the contexts of its grams are compared window by window."""
    rng = random.Random(3)
    base = rng.choices([f"w{i}" for i in range(4000)], k=260)
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice([f"e{i}", "common"])
        rows.append((i, " ".join(w)))
    assert covered(spark, rows, group_rows=3) == brute(rows) == covered(spark, rows)


def test_one_very_long_text_and_clashing_columns(spark):
    rng = random.Random(6)
    w = rng.choices([f"w{i}" for i in range(3000)], k=40_000)
    rows = [(1, " ".join(w)), (2, " ".join(w[20_000:20_060])), (2, " ".join(w[:49]))]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, g int, pos int, start_word int")
    got = {(r["id"], r["start_word"], r["end_word"], r["other_id"]) for r in repeated_passages(df).collect()}
    assert got == {(1, 20_000, 20_060, 2), (2, 0, 60, 1)}


def test_empty(spark):
    assert covered(spark, []) == set()


def test_minimisers_meet_in_every_window():
    from tessera.llm.common import COUNTERS
    from tessera.llm.suffixes import minimisers

    code = np.random.default_rng(0).integers(0, 50, 400).astype(np.uint64)
    row = np.repeat([0, 1], 200)
    levels = np.random.default_rng(1).integers(0, 8, COUNTERS).astype(np.uint64)
    at, _ = minimisers(code, row, 5, 10, levels)
    for lo in (0, 200):
        mine = at[(at >= lo) & (at < lo + 200)]
        assert all(((mine >= k) & (mine < k + 10)).any() for k in range(lo, lo + 200 - 14))
