import hashlib
import random
import re

import duckdb
import pytest

from tessera.llm import fim, queries

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= rate:
        return (doc_id, text, len(units), "plain", None, None, text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, text, len(units), form, len(p), len(m), out)


BITS = ["a", "word", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\xa0", "é", "漢字", "🙂", "<", "<S", "<P>", "S>", "\r\n", "<M>"]


def key(r):
    return repr(r)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(BITS, [6, 6, 6, 2, 1, 1, 1, 1, 1, 2, 2, 2, 1, 1, 0.02, 1, 1, 0.02], k=rng.randint(0, 40)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, " \n\t"), (1004, "one"), (1005, " x " * 30000), (None, "no id here at all"), (None, None), (None, "another one without")]
    rows += [rows[7], rows[7], rows[20], (20, "the same id with another text"), (1005, " x " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for cfg in (fim.FimConfig(), fim.FimConfig(7, 100, 50), fim.FimConfig(7, 0, 50)):
        got = fim.fill_in_middle(df, cfg)
        assert got.columns == ["id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
        want = [brute(*r, cfg.seed, cfg.rate, cfg.spm_rate) for r in rows]
        assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, want))
        back = got.select("text", fim.restored(got["output"], got["form"]).alias("b"))
        assert back.where("text <> b").count() == 0


def test_many_equal_rows_and_clashing_names(spark):
    text = "again and again the very same words in every row"
    rows = [(5, text, "x", 1)] * 300 + [(k, text, "y", 2) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(2)
    got = [tuple(r) for r in fim.fill_in_middle(df, fim.FimConfig(rate=100)).collect()]
    assert sorted(map(key, got)) == sorted(key(brute(r[0], r[1], rate=100)) for r in rows)


def test_other_names_and_empty_table(spark):
    df = spark.createDataFrame([("k1", "some words to cut"), (None, "x")], "key string, body string")
    got = {r["id"]: r["n"] for r in fim.fill_in_middle(df, id_col="key", text_col="body").collect()}
    assert got == {"k1": 4, None: 1}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(none).count() == 0


@pytest.mark.parametrize("query", ["op11_fill_in_middle"])
def test_query_equals_sql(spark, sf, query):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL[query])
    got = queries.QUERIES[query](spark, sf)
    assert got.columns == want.columns
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, want.fetchall()))
