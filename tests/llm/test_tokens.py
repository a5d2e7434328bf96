import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, tokenfile
from tessera.llm.common import scratch_dir
from tessera.llm.textnum import gathered
from tessera.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
BITS = [
    "a", "B", "é", "É", "é", "'s", "'t", "'", "!!", "...", "1", "23", "²", " ", " ", "\x1c", "\x85", "Σ", "ΟΣ", "İ", "İ.",
    "ǅ", "ß", "漢字", "🙂", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "́", "‍", "ﬁ", "\t", "\n", " ", "  ", "the", "Ab.", "x-y", "&&&", "\x00",
]
TEXTS = [None, "", " ", "Hello, world! It's a test.", "the " * 5000, "x" * 9000]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def ids_of(reference, text):
    return reference.encode(text or "", add_special_tokens=False).ids + [1]


def test_word_encoder_equals_the_library(reference):
    rng = random.Random(3)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 12))) for _ in range(3000)]
    enc = WordEncoder(PATH, cache_words=300)
    for i in range(0, len(texts), 11):
        some = texts[i : i + 11]
        ids, at = enc.encode(pa.array(some), 1)
        for k, t in enumerate(some):
            assert ids[at[k] : at[k + 1]].tolist() == ids_of(reference, t), repr(t)


@pytest.mark.parametrize("n, block", [(0, 8), (1, 8), (7, 8), (8, 8), (1000, 64), (20000, 4096)])
def test_file_round_trip(n, block):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49407).astype(np.uint32)
    if n > 100:
        ids[n // 2 :] = ids[: n - n // 2]  # what orders 1 and 2 can learn
    docs = np.array([n]) if n else np.zeros(0, np.int64)
    data = tokenfile.pack_file(np.arange(len(docs)), docs, ids, block)
    _, counts, back = tokenfile.unpack_file(data)
    assert np.array_equal(back, ids) and np.array_equal(counts, docs)


def test_context_helps():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 40000, 200)
    ids = np.tile(phrase, 60).astype(np.uint32)
    data = tokenfile.pack_file(np.array([0]), np.array([len(ids)]), ids)
    assert len(data) * 8 / len(ids) < 3  # order 0 alone needs 7.6 bits


def test_damage_is_found():
    ids = np.arange(500, dtype=np.uint32)
    data = bytearray(tokenfile.pack_file(np.array([3]), np.array([500]), ids))
    for at in (0, 20, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(tokenfile.FileError):
            tokenfile.unpack_file(bytes(bad))
    with pytest.raises(tokenfile.FileError):
        tokenfile.unpack_file(bytes(data[:-7]))
    # a block's own checksum holds where the file's has been forged
    bad = bytearray(data)
    bad[-60] ^= 1
    bad[-4:] = struct.pack("<I", zlib.crc32(bad[:-4]))
    with pytest.raises(tokenfile.FileError):
        tokenfile.unpack_file(bytes(bad))


def test_write_and_read(spark, reference):
    rows = [(i * 7 % 50, t, "x", 1) for i, t in enumerate(TEXTS * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string, start int")
    out = scratch_dir(spark, "t")
    manifest = tokenfile.write_tokens(df, out, PATH, file_tokens=3000).orderBy("file").collect()
    starts, total = {}, 0
    for r in manifest:
        starts[r["file"]], total = total, total + r["tokens"]
    got = sorted(tokenfile.read_tokens(spark, out, starts).collect(), key=lambda r: r["start"])
    want = sorted((r[0], r[1] or "") for r in rows)
    at = 0
    assert len(got) == len(want)
    for r, (i, t) in zip(got, want, strict=True):
        ids = ids_of(reference, t)
        assert (r["doc_id"], r["start"], r["n_tokens"], list(r["tokens"])) == (i, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_write_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfile.write_tokens(df, scratch_dir(spark, "t"), PATH).collect() == []


# ---------------------------------------------------------------- packing


def exact_bins(sizes, capacity):
    """The least number of bins, by trying all ways."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(order):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= order[i] and rooms[k] not in rooms[:k]:
                place(i + 1, [*rooms[:k], rooms[k] - order[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - order[i]])

    order = sorted(sizes, reverse=True)
    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_pack_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(20, 70) for _ in range(rng.randint(1, 12))]
    bins = packing.pack(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) == exact_bins(sizes, 100)


def test_branch_and_bound_beats_best_fit():
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]  # best fit decreasing needs four bins of 61
    assert len(packing.best_fit(sizes, 61)) == 4 and len(packing.pack(sizes, 61)) == exact_bins(sizes, 61)


def test_pieces_and_sequences(spark, reference):
    rows = [(i, t, "x", 0) for i, t in enumerate(TEXTS * 8)] + [(None, "no id", "x", 0), (3, TEXTS[3], "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string, piece int")
    packed = packing.pack_pieces(packing.pieces(df, PATH), group_rows=20).collect()
    assert len(packed) == sum(-(-len(ids_of(reference, t)) // 4096) for _, t, *_ in rows)
    by_seq = {}
    for r in packed:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["id"] is not None:
            ids = ids_of(reference, TEXTS[r["id"] % 6])[r["start"] : r["start"] + 4096]
            assert r["start"] == 4096 * r["piece"] and r["length"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    for s in by_seq.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 4096
    assert len(by_seq) <= -(-sum(r["length"] for r in packed) // 4096) + 1


def test_many_equal_pieces(spark):
    """Thousands of equal rows without an id are spread over groups, packed tightly and all kept."""
    piece = (None, 0, 0, 1000, 7)
    df = spark.createDataFrame([piece] * 4001 + [(k, 0, 0, 90, 1) for k in range(400)], "id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    sizes = []
    solver = packing._solver

    def counted(*args):
        solve = solver(*args)
        return lambda key, rows: solve(key, rows).assign(ids_crc32=len(rows))

    packing._solver = counted  # the checksum column tells how many rows the group had
    try:
        packed = packing.pack_pieces(df, group_rows=400).collect()
    finally:
        packing._solver = solver
    sizes = [r["ids_crc32"] for r in packed]
    assert len(packed) == 4401 and max(sizes) <= 800
    total = sum(r["length"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) <= max(-(-total // 4096), -(-4001 // 4)) + 12


def test_pack_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_pieces(packing.pieces(df, PATH)).collect() == []


def test_frequent_words_stay_known(reference, monkeypatch):
    """When the cache is full only words that were not met of late go: the library isn't asked again for those that return."""
    enc, asked = WordEncoder(PATH, cache_words=150), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words: (asked.extend(words), learn(words)))
    for k in range(40):
        text = " ".join(["often", "again"] + [f"rare{k}x{i}" for i in range(60)])
        ids, _ = enc.encode(pa.array([text]), 1)
        assert ids.tolist() == ids_of(reference, text)
        assert len(enc.cache) + len(enc.old) < 3 * 150
    assert asked.count("often") == asked.count("again") == 1


def test_bytes_are_spelt_once(reference):
    """The library is given pre-tokens in its byte alphabet and doesn't split or spell them again."""
    enc = WordEncoder(PATH)
    assert enc.bare.pre_tokenizer is None and enc.bare.normalizer is None
    texts = [f"a{chr(i)}b {chr(i)}c {chr(i)}" for i in [*range(0x180), 0x3A3, 0x301, 0x20AC, 0x4E2D, 0x1F600] if not chr(i).isspace()]
    ids, at = enc.encode(pa.array([*texts, "", "ab ab", "É''' é<|endoftext|>x"]), 1)
    for i, text in enumerate([*texts, "", "ab ab", "É''' é<|endoftext|>x"]):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(reference, text)
    assert enc.encode(pa.array([], pa.string()), 1)[0].tolist() == []


def test_runs_are_learnt_once(reference, monkeypatch):
    """Words are cut where pre-tokens must end: the library isn't asked again for letters that stand beside other marks or digits."""
    enc, asked = WordEncoder(PATH), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words: (asked.extend(words), learn(words)))
    texts = ["stone. (stone-stone) 5stone7", "#stone\tstone... «stone» größe/größe, Жук", "", "7 stone's 'll stone'll", "жук?? Größe!"]
    ids, at = enc.encode(pa.array(texts), 1)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(reference, text)
    assert [w for w in asked if "stone" in w] == ["stone", "«stone»"] and [w for w in asked if "größe" in w] == ["größe"]


def test_cut_words_equal_the_library(reference):
    rng = random.Random(8)
    bits = [*"aZéÉßİıŊЖёſ×÷…·ªº١²0 7 .,'-=#)<>|_", "'s", "'re", "'LL", "́", "̸", " ", "ͅ", "Ǆ", "ŉ", "Ⱥ", "ꙮ", " ", "\x1f", "가", "ẞ"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(6000)]
    enc = WordEncoder(PATH, cache_words=500)
    for i in range(0, len(texts), 100):
        column = pa.array(["not in the slice", *texts[i : i + 100]]).slice(1)
        ids, at = enc.encode(column, 1)
        for k, t in enumerate(texts[i : i + 100]):
            assert ids[at[k] : at[k + 1]].tolist() == ids_of(reference, t), repr(t)


def test_small_batches_are_joined():
    """Every slice has to look up its words, so batches of few bytes are encoded together; none of the rows is lost or moved."""
    texts = ["a" * n for n in [5, 0, 3000, 1, 12000, 2, 2, 0, 700] * 40]
    rows = pa.record_batch({"id": list(range(len(texts))), "text": texts})
    batches = [rows.slice(i, 7) for i in range(0, len(texts), 7)]
    got = list(gathered(iter(batches), "text", 10_000))
    assert [x for b in got for x in b.to_pylist()] == rows.to_pylist()
    assert all(b.nbytes <= 10_100 or b.num_rows == 1 for b in got)
    assert all(a.nbytes + b.nbytes > 10_000 for a, b in zip(got, got[1:]))
    assert len(list(gathered([rows.slice(k % 9, 1) for k in (1, 3) * 500], "text", 1 << 20))) == 1
    assert list(gathered([rows.slice(0, 0)], "text", 10)) == []


def test_places_and_points_agree():
    """A point in the interval of a symbol finds that symbol, whatever both contexts predict."""
    rng = np.random.default_rng(4)
    counts = np.concatenate([np.full(3000, 1), rng.integers(1, 10**6, 50), [10**9]])
    table = tokenfile.frequencies(rng.permutation(counts))
    n = len(counts)
    for seed in range(6):
        model = tokenfile.Mixer(n, table)
        for _ in range(4):
            few = rng.integers(0, 3, n).astype(np.uint32)
            model.predict()
            model.place(few)
            model.learn(few)
        model.predict()
        sym = rng.permutation(n).astype(np.uint32) if seed else few
        low, width = model.place(sym)
        assert width.min() > 0
        for v in (low, low + width // 2, low + width - 1):
            assert (model.find(v.astype(np.uint64)) == sym).all()
