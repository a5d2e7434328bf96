import random

from tessera.llm import decontaminate as dc

rng = random.Random(4)
VOCAB = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choices(VOCAB, k=n))


def edited(text, k):
    t = list(text)
    for _ in range(k):
        p = rng.randrange(len(t))
        t[p : p + 1] = rng.choice([[], ["#"], [t[p], "#"]])
    return "".join(t)


def distance(a, b):
    """Least edits between ``a`` and any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def clean(t):
    return " ".join("".join(c.lower() if c.isascii() else c for c in t).split())


def brute(docs, items, s=dc.Settings()):
    out = set()
    for d, text in docs:
        for i, t in items:
            t = clean(t or "")
            w = min(s.window, len(t))
            if w < s.q:
                continue
            k = min(int(w * s.edit_rate), (w - s.q) // s.q)
            starts = sorted({*range(0, len(t) - w + 1, s.window // 2), len(t) - w})
            if any(distance(t[a : a + w], clean(text or "")) <= k for a in starts):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    items = [(i, prose(rng.randint(8, 40))) for i in range(8)] + [(50, ""), (51, None), (52, "tiny"), (53, "ein Stück Text, naïve façade älter")]
    docs = []
    for d in range(40):
        t = prose(rng.randint(0, 60))
        if d % 2:
            item = items[rng.randrange(8)][1]
            part = item[: rng.choice([len(item), 64, 70, 40])]
            t += " " + rng.choice([part, part.upper(), part.replace(" ", "\n  "), edited(part, rng.randint(1, 6))]) + " " + prose(rng.randint(0, 30))
        docs.append((d, t))
    docs += [(100, None), (101, ""), (102, "é 🙂 EIN  Stück Text, naïve façade älter."), (None, items[0][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, start int")
    bench = spark.createDataFrame([(*r, "u") for r in items], "item_id long, text string, doc_id string")
    got = dc.matches(df, bench)
    assert {(r["id"], r["item_id"]) for r in got.collect()} == brute(docs, items)
    hit = got.where("id = 102").first()
    assert docs[42][1][hit["start"] : hit["end"]] == "EIN  Stück Text, naïve façade älter"
    kept = dc.without_contaminated(df, bench)
    assert kept.columns == df.columns
    bad = {d for d, _ in brute(docs, items)}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad)


def test_blocks_of_the_benchmark_add_up(spark):
    items = [(i, prose(20)) for i in range(10)]
    docs = [(i, prose(10) + " " + t) for i, t in items]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, dc.matches(df, bench).collect()))
    assert sorted(map(tuple, dc.matches(df, bench, block_chars=200).collect())) == one
    assert {r[:2] for r in one} >= {(i, i) for i in range(10)}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.matches(docs, bench).collect() == []
    full = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert dc.matches(full, bench).collect() == []
    assert dc.without_contaminated(full, bench).count() == 1


def test_item_without_id_is_not_another(spark):
    from tessera.llm.decontaminate import matches

    a, b = (" ".join(f"{c}{i}word" for i in range(30)) for c in "ab")
    items = spark.createDataFrame([(None, a), (-1, b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"x {b} y")], "doc_id long, text string")
    assert sorted((r["id"], r["item_id"]) for r in matches(docs, items).collect()) == [(1, None), (2, -1)]
