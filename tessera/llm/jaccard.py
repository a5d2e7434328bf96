"""Jaccard self-join of word-shingle sets by parity sketches.

A set's sketch is a row of cells; every shingle is XOR-hashed into one cell, so
sets that differ in d shingles differ in at most d cells: the Hamming distance
over cells bounds the symmetric difference from below.  A linked pair differs
in at most D shingles, so any D + 1 cells of one hold a cell that both have
alike.  Every set therefore emits the D + 1 cells that are least in one global
order as join keys, D being the largest difference that any partner of its
allows, and linked pairs share a key, whatever their size.

* Bands grow by two; a set whose partners may reach the next band emits there
  too, so every admissible pair of sizes shares a band.
* The order puts frequent contents last.  A first pass counts shingles in
  ``COUNTERS`` counters; a cell counts as its rarest shingle.  Counts only
  choose the order, so collisions and noise in them can lose no pair.
* A cell without shingles is no key.  A set with fewer filled cells than D + 1
  emits them all and repeats the sketch under further hash seeds, and after
  ``SEEDS`` of them joins the band's common bucket.

Sets that share a key are a bucket.  Each is compared with the bucket's hub,
the set for which the key stands earliest.  Where a bucket's sets are in
several components after that:

* up to ``SMALL`` sets are compared by size and bit sketch between components,
  inside the join, which puts out likely links only;
* more are dealt again by how they differ from what most of them hold.  Let
  A and B be the differences of two linked sets from that common content.
  Either A and B have together at most D elements; then both sets link with
  the one that is closest to the common content, with which all are compared.
  Or A and B meet, and differ in at most D elements; so the D + 1 elements of a
  difference that are least in the order are the keys of new buckets.  Sets that
  only have the common content in common meet no more.  No element is in the
  differences of more than half of the ``VOTERS`` that the content was taken
  from, so buckets about halve until none is left.

So no group is compared in all its pairs, and no candidate is dropped.  Pairs
are filtered by a bit sketch of ``BITS`` parities with the same bound, those of
more than ``WIDE`` shingles also by one that is as wide as their set needs, and
verified on the full sets.  Equal sets are one vertex throughout.

Defined results: words are runs of bytes other than space and 9 to 13, with A-Z
lower-cased; a text of fewer than ``k`` words is one shingle; a null, empty or
blank text has no shingles and links with nothing; rows that share an id are
one vertex; a row with a null id links with nothing and its component is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import COUNTERS, IdFilter, counter_of, counter_rows, cut, released, spent, summed
from tessera.llm.components import components
from tessera.llm.textnum import LOWER, U64, hash_spans, mix, shingles, slices, text_bytes, unique_per_row, words

SEEDS = 4
SMALL = 256
#: About so many sets of a group, by a hash, tell what most of it holds; any content would give the same links.
VOTERS = 64
BITS = 2048
#: Larger sets say too little in ``BITS`` parities.
WIDE = 1024
#: Bytes of text that are hashed at a time: a worker's arrays are some hundred times as large.
SLICE = 1 << 19
#: So many bits of a key are counted to tell whether it may be shared: fewer bits travel, and more keys may seem shared.
COUNTED = 48


def difference(total, percent: int):
    """The largest symmetric difference of a linked pair of sets with ``total`` elements together."""
    return total * (100 - percent) // (100 + percent)


def largest_difference(n, percent: int):
    """The largest symmetric difference that a set of ``n`` can have from any partner."""
    return difference(n + n * 100 // percent, percent)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, and their rows."""
    raw, at = text_bytes(column)
    raw = LOWER[raw]
    start, end, row = words(raw, at)
    return unique_per_row(*shingles(hash_spans(raw, start, end), row, len(column), k))


def first_of_rows(row: np.ndarray, keys: tuple[np.ndarray, ...], most: np.ndarray) -> np.ndarray:
    """Positions of the first ``most[row]`` entries of each row in the order of ``keys``, in that order."""
    order = np.lexsort((*reversed(keys), row))
    r = row[order]
    starts = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
    return order[rank < most[r]]


def cell_keys(h: np.ndarray, row: np.ndarray, n: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of every set and their rows, by row and in the order; ``n`` has the sets' sizes."""
    own = np.log2(np.maximum(n, 1)).astype(np.int64)
    rarity = counts[counter_of(h)]
    keys, rows, ranks = [], [], []

    def emit(key: np.ndarray, of: np.ndarray) -> None:
        keys.append(key)
        rows.append(of)
        ranks.append(np.arange(len(key)))

    for step in (0, 1):
        g = own + step
        active = n > 0
        most = largest_difference(n, percent) + 1
        if step:
            active &= n * 100 >= (np.int64(1) << g) * percent
        else:  # partners beyond the band are met in the next
            most = np.minimum(most, difference(n + (np.int64(2) << g) - 1, percent) + 1)
        for seed in range(SEEDS + 1):
            if not active.any():
                break
            if seed == SEEDS:  # the band's common bucket
                rest = np.flatnonzero(active)
                emit(mix(g[rest].astype(U64) + U64(1 << 40)), rest)
                break
            use = active[row]
            hh, r, c = h[use], row[use], rarity[use]
            cell = mix(hh ^ U64(0x51ED2701 * (seed + 1))) >> (U64(63) - g[r].astype(U64))  # 2 ** (g + 1) cells
            order = np.lexsort((cell, r))
            rr, cc = r[order], cell[order]
            first = np.flatnonzero(np.append(True, (rr[1:] != rr[:-1]) | (cc[1:] != cc[:-1])))
            value = np.bitwise_xor.reduceat(mix(hh[order] ^ U64(0x6A09E667F3BCC909)), first)
            rare = np.minimum.reduceat(c[order], first)
            r, cell = rr[first], cc[first]
            key = mix(value ^ mix(cell + (g[r] * (SEEDS + 1) + seed).astype(U64) * U64(1 << 50)))
            some = first_of_rows(r, (rare, key), most)
            emit(key[some], r[some])
            active = active & (np.bincount(r, minlength=len(n)) < most)
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    key, of = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(of, kind="stable")
    return key[order], of[order]


# --------------------------------------------------------------------- Spark


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def _identities(k: int):
    """``(id, n, h1, h2)`` of each row's set, then the task's counters, ``chunk`` by ``chunk``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        names = ["id", "n", "h1", "h2", "chunk", "counts"]
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                h, row = shingle_sets(b.column("text"), k)
                counts += np.bincount(counter_of(h), minlength=COUNTERS)
                m = b.num_rows
                n = np.bincount(row, minlength=m)
                h1, h2 = np.zeros(m, U64), np.zeros(m, U64)
                some = np.flatnonzero(n)
                if len(some):
                    first = np.append(0, np.cumsum(n[some])[:-1])
                    h1[some] = np.add.reduceat(mix(h ^ U64(0x243F6A8885A308D3)), first)
                    h2[some] = np.bitwise_xor.reduceat(mix(h ^ U64(0x13198A2E03707344)), first)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                     pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                    names,
                )
        if counts.any():
            chunk, parts = counter_rows(counts)
            none = pa.nulls(len(chunk), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, chunk, parts], names)

    return run


SKETCH = [f"s{i}" for i in range(BITS // 64)]


def _copy_filters(members: DataFrame) -> tuple[IdFilter, IdFilter]:
    """A filter of the rows that are copies, and one of the others that the first takes for copies too."""
    marked = members.select("id", "rep", F.col("id").bitwiseXOR(F.col("h1")).alias("mark"))
    copied = IdFilter.of(marked.where("id <> rep"), "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(copied.may_hold(np.asarray(b.column("mark")))))

    mistaken = cut(marked.where("id = rep").select("mark").mapInArrow(run, "mark long"), "mistaken")
    return copied, IdFilter.of(mistaken, "mark")


def _sketches(k: int, counts: np.ndarray, percent: int, copied: IdFilter, mistaken: IdFilter):
    """``(id, h1, n, s0.., keys)``: identity, size, bit sketch and join keys of each row's set.

    Rows that are copies for sure are left out: their keys would look shared.
    """
    counts = counts.astype(np.int32 if counts.max() < 1 << 31 else np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                h, row = shingle_sets(b.column("text"), k)
                m = b.num_rows
                n = np.bincount(row, minlength=m)
                h1 = np.zeros(m, U64)
                some = np.flatnonzero(n)
                if len(some):
                    h1[some] = np.add.reduceat(mix(h ^ U64(0x243F6A8885A308D3)), np.append(0, np.cumsum(n[some])[:-1]))
                mark = np.asarray(b.column("id")) ^ h1.view(np.int64)
                stays = (n > 0) & (~copied.may_hold(mark) | mistaken.may_hold(mark))
                use = stays[row]
                h, row = h[use], (np.cumsum(stays) - 1)[row[use]]
                b, n, h1 = b.filter(pa.array(stays)), n[stays], h1[stays]
                m = b.num_rows
                bits = np.zeros(m * BITS, np.uint8)
                odd, times = np.unique(row * BITS + (h >> U64(8)).astype(np.int64) % BITS, return_counts=True)
                bits[odd] = times & 1
                sketch = np.packbits(bits).view(np.int64).reshape(m, len(SKETCH))
                key, of = cell_keys(h, row, n, counts, percent)
                at = np.append(0, np.cumsum(np.bincount(of, minlength=m))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(h1.view(np.int64)), pa.array(n.astype(np.int64))]
                    + [pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(len(SKETCH))]
                    + [pa.ListArray.from_arrays(pa.array(at), pa.array(key.view(np.int64)))],
                    ["id", "h1", "n", *SKETCH, "keys"],
                )

    return run


def _shared_keys(wanted: IdFilter):
    """``(key, id, h1, pos)``: the keys that may be shared, and where they stand in their set's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("keys")
            at = np.asarray(keys.offsets, np.int64)
            key = np.asarray(keys.flatten())
            size = np.diff(at)
            of = np.repeat(np.arange(b.num_rows), size)
            pos = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
            some = np.flatnonzero(wanted.may_hold(key))
            of = pa.array(of[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[some]), b.column("id").take(of), b.column("h1").take(of), pa.array(pos[some].astype(np.int32))], ["key", "id", "h1", "pos"]
            )

    return run


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``(id, set)`` for the documents in ``ids``: rows are picked at the scan, by a filter that lets few others through."""
    wanted = IdFilter.of(ids, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b0 = batch.filter(pa.array(wanted.may_hold(np.asarray(batch.column("id")))))
            for b in slices(b0, "text", SLICE):
                h, row = shingle_sets(b.column("text"), k)
                at = np.append(0, np.cumsum(np.bincount(row, minlength=b.num_rows))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], ["id", "set"])

    texts = _texts(docs, id_col, text_col).where("id is not null")
    made = cut(texts.mapInArrow(released(run), "id long, set array<long>"), "sets")
    return made.join(ids, "id", "left_semi")


def _hubs(rows: DataFrame) -> DataFrame:
    """``(key, id, hub, size)`` for the keys that several rows of ``(key, id, pos)`` share.

    Rows that share an id may have a key twice: they count twice in ``size``,
    which only picks the way in which a bucket is compared.
    """
    least = rows.groupBy("key").agg(F.min(F.struct("pos", "id"))["id"].alias("hub"), F.count("*").alias("size")).where("size > 1")
    return cut(rows.join(least, "key").select("key", "id", "hub", "size"), "buckets")


def _admissible(percent: int) -> Column:
    """Whether sizes and bit sketches of ``u_`` and ``v_`` leave a link possible."""
    total = F.col("u_n") + F.col("v_n")
    most = F.floor(total * (100 - percent) / (100 + percent))
    apart = sum((F.bit_count(F.col(f"u_{s}").bitwiseXOR(F.col(f"v_{s}"))) for s in SKETCH), F.lit(0))
    return (F.abs(F.col("u_n") - F.col("v_n")) <= most) & (apart <= most)


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{side}_{c}" if c != "id" else side) for c in rows.columns])


def _likely(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs ``(u, v)`` that sizes and bit sketches leave over."""
    both = pairs.distinct().join(_side(facts, "u"), "u").join(_side(facts, "v"), "v")
    return cut(both.where(_admissible(percent)).select("u", "v").distinct(), "pairs")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("id"))


def _picked(sets: DataFrame, ids: DataFrame, then=None, schema: str = "id long, set array<long>") -> DataFrame:
    """The sets of ``ids`` and a few more: most of the others stay out of the shuffle.

    ``then`` works on what is left in the same Python worker: a second function
    in a row would take a worker of its own in every task, which lives on.
    """
    wanted = IdFilter.of(ids.distinct(), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(wanted.may_hold(np.asarray(b.column("id")))))
            yield b if then is None else then(b)

    return sets.mapInArrow(released(run), schema)


def _wide_sketch(b: pa.RecordBatch) -> pa.RecordBatch:
    """``(id, n, wide)`` of each set: parities in at least four bits an element, a power of two."""
    at = np.asarray(b.column("set").offsets, np.int64)
    h = np.asarray(b.column("set").flatten()).view(U64)
    at, wide = at - at[0], []
    for i in range(b.num_rows):
        own = h[at[i] : at[i + 1]]
        size = 4 << max(1, len(own)).bit_length()
        odd = np.bincount((own >> U64(8)).astype(np.int64) & (size - 1), minlength=size) & 1
        wide.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(at)), pa.array(wide, pa.binary())], ["id", "n", "wide"])


def _near(percent: int):
    """The pairs ``(u, v)`` that their wide sketches leave over; the longer is folded to the length of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = difference(np.asarray(b.column("u_n")) + np.asarray(b.column("v_n")), percent)
            stays = np.ones(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("u_wide"), b.column("v_wide"), strict=True)):
                x, y = (np.frombuffer(w.as_buffer(), np.uint8) for w in (x, y))
                size = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(w.reshape(-1, size)) for w in (x, y))
                stays[i] = np.bitwise_count(x ^ y).sum() <= most[i]
            yield b.select(["u", "v"]).filter(pa.array(stays))

    return run


def _narrowed(likely: DataFrame, facts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``likely`` without the pairs of large sets that wide sketches rule out."""
    large = facts.where(F.col("n") > WIDE).select(F.col("id").alias("u")).distinct()
    doubtful = cut(likely.join(large, "u", "left_semi"), "doubtful")
    ids = cut(_ends(doubtful).distinct(), "ends")
    wide = cut(_picked(sets, ids, _wide_sketch, "id long, n long, wide binary").join(ids, "id", "left_semi"), "wide")
    both = doubtful.join(_side(wide, "u"), "u").join(_side(wide, "v"), "v").select("u", "v", "u_n", "v_n", "u_wide", "v_wide")
    return likely.join(large, "u", "left_anti").unionByName(cut(both.mapInArrow(released(_near(percent)), "u long, v long"), "near"))


def _linked(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets reach the threshold."""
    sets = _picked(sets, _ends(likely))
    both = (
        likely.join(_side(sets, "u"), "u").join(_side(sets, "v"), "v")
        .select("u", "v", F.size(F.array_intersect("u_set", "v_set")).alias("both"), (F.size("u_set") + F.size("v_set")).alias("total"))
    )
    return cut(both.where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * percent).select("u", "v").distinct(), "links")


def _differences(counts: np.ndarray, percent: int):
    """``(g, id, off, keys)``: how far a set is from its group's common content, and where it differs from it.

    ``keys`` are the least elements of the difference, as keys of that group;
    those that the set lacks come last.  ``off`` is least for the set with
    which all link that are close enough to the content to link by it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                both = [b.column("set"), b.column("common")]
                sizes = [np.diff(np.asarray(c.offsets, np.int64)) for c in both]
                m = b.num_rows
                row = np.concatenate([np.repeat(np.arange(m), s) for s in sizes])
                h = np.concatenate([np.asarray(c.flatten()).view(U64) for c in both])
                lacks = np.repeat([False, True], [sizes[0].sum(), sizes[1].sum()])
                order = np.lexsort((h, row))
                same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
                alone = order[~(np.append(same, False) | np.append(False, same))] if len(order) else order
                h, row, lacks = h[alone], row[alone], lacks[alone]
                off = np.bincount(row, minlength=m) * (100 + percent) - sizes[0] * (100 - percent)
                some = first_of_rows(row, (lacks, counts[counter_of(h)], h), largest_difference(sizes[0], percent) + 1)
                h, row = h[some], row[some]
                key = mix(h ^ mix(np.asarray(b.column("g")).astype(np.int64).view(U64)[row] + U64(0x3C6EF372FE94F82B)))
                at = np.append(0, np.cumsum(np.bincount(row, minlength=m))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(at), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("g"), b.column("id"), pa.array(off), keys], ["g", "id", "off", "keys"])

    return run


def _apart(groups: DataFrame, sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """What ``_differences`` gives for the groups ``(g, id)``."""
    groups = cut(groups, "groups")
    sets = cut(_picked(sets, groups.select("id")), "large")
    size = groups.groupBy("g").agg(F.count("*").alias("size"))
    voters = groups.join(size, "g").where(F.pmod(F.xxhash64("id", "g"), F.greatest(F.lit(1), F.floor(F.col("size") / VOTERS))) == 0).select("g", "id")
    votes = cut(voters.join(_picked(sets, voters.select("id")), "id").select("g", F.explode("set").alias("h")).groupBy("g", "h").agg(F.count("*").alias("n")), "votes")
    needed = voters.groupBy("g").agg(F.count("*").alias("voters"))
    common = votes.join(needed, "g").where("2 * n > voters").groupBy("g").agg(F.collect_list("h").alias("common"))
    rows = groups.join(sets, "id").join(common, "g", "left").select("g", "id", "set", F.coalesce("common", F.array().cast("array<long>")).alias("common"))
    return cut(rows.mapInArrow(released(_differences(counts, percent)), "g long, id long, off long, keys array<long>"), "apart")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``.

    Two texts link when ``100 * |intersection| >= percent * |union|`` of their
    sets of ``k``-word shingles; ``percent`` is 51 to 99.
    """
    if not 51 <= percent <= 99:
        raise ValueError("percent must be 51 to 99: bands grow by two")
    texts = _texts(docs, id_col, text_col)
    first = cut(texts.mapInArrow(released(_identities(k)), "id long, n long, h1 long, h2 long, chunk int, counts binary"), "identities")
    counts = summed(first.where("chunk is not null"))
    rows = first.where("chunk is null").select("id", "n", "h1", "h2")
    repeated = cut(
        rows.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
        .where("rep < last").drop("last"),
        "repeated",
    )
    members = cut(
        rows.join(repeated, ["h1", "h2", "n"], "left").select("id", "n", "h1", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")),
        "members",
    )
    copies = members.where("id <> rep")
    # an id of several rows may be a copy in one and stand for itself in another
    same = copies.select(F.col("rep").alias("u"), F.col("id").alias("v")).join(
        members.where("id = rep").select(F.col("id").alias("v")), "v", "left_semi"
    )

    names = ", ".join(f"{s} long" for s in SKETCH)
    sk = cut(
        texts.where("id is not null").mapInArrow(released(_sketches(k, counts, percent, *_copy_filters(members))), f"id long, h1 long, n long, {names}, keys array<long>"), "sketches"
    )
    counted = sk.select(F.explode("keys").alias("key")).select(F.col("key").bitwiseAND(F.lit((1 << COUNTED) - 1)).alias("key"))
    shared = cut(counted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    keyed = cut(sk.select("id", "h1", "keys").mapInArrow(_shared_keys(IdFilter.of(shared, "key")), "key long, id long, h1 long, pos int"), "keys")
    buckets = _hubs(keyed.join(copies.select("id", "h1"), ["id", "h1"], "left_anti").select("key", "id", "pos"))
    facts = cut(sk.select("id", "n", *SKETCH).join(buckets.select("id").distinct(), "id", "left_semi"), "facts")
    spent(sk, shared, keyed, first)
    likely = _likely(buckets.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")), facts, percent)
    known = cut(_ends(likely).unionByName(buckets.where(F.col("size") > SMALL).select("id")).distinct(), "known")
    sets, more = _sets(docs, known, id_col, text_col, k), True
    likely = cut(_narrowed(likely, facts, sets, percent), "narrowed")
    found = components(_linked(likely, sets, percent).unionByName(same.select("u", "v")))
    while True:
        placed = cut(
            buckets.where("size > 2").join(found, "id", "left").withColumn("component_id", F.coalesce("component_id", "id")), "placed"
        )
        mixed = placed.groupBy("key").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a < b").select("key")
        mixed = cut(placed.join(mixed, "key", "left_semi"), "mixed")
        if not mixed.take(1):
            break
        few = mixed.where((F.col("size") <= SMALL) & (F.col("id") != F.col("hub"))).select("key", "id", "component_id").join(facts, "id")
        u, v = _side(few, "u"), _side(few, "v")
        meets = (F.col("u_key") == F.col("v_key")) & (F.col("u") < F.col("v")) & (F.col("u_component_id") != F.col("v_component_id"))
        likely = cut(u.join(v, meets & _admissible(percent)).select("u", "v").distinct(), "pairs")
        if more:  # later rounds only deal sets of large buckets again
            sets = sets.unionByName(_sets(docs, _ends(likely).distinct().join(known, "id", "left_anti"), id_col, text_col, k))
        large = mixed.where(F.col("size") > SMALL)
        if more:  # buckets of the cells of one family lie in one another: one group for each hub
            groups = large.select(F.col("hub").alias("g"), "id").distinct()
        else:  # of buckets with the same sets, one
            same_sets = large.select("key", "id").distinct().groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
            groups = large.join(same_sets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi").select(F.col("key").alias("g"), "id").distinct()
        more = False
        apart = _apart(groups, sets, counts, percent)
        closest = apart.groupBy("g").agg(F.min(F.struct("off", "id"))["id"].alias("u"))
        buckets = _hubs(apart.select("id", F.posexplode("keys").alias("pos", "key")))
        stars = buckets.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v"))
        stars = stars.unionByName(apart.join(closest, "g").select("u", F.col("id").alias("v")).where("u <> v"))
        likely = _narrowed(likely.unionByName(_likely(stars, facts, percent)).distinct(), facts, sets, percent)
        links = _linked(cut(likely, "narrowed"), sets, percent)
        found = components(found.select(F.col("component_id").alias("u"), F.col("id").alias("v")).unionByName(links))
    found = found.withColumnRenamed("id", "rep").withColumnRenamed("component_id", "least")
    return members.join(found, "rep", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("least", "rep").alias("component_id")
    )
