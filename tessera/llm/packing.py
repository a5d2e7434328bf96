"""Packing of documents into sequences by bin completion.

Documents become token ids; longer ones are cut into pieces of the capacity.
Pieces are dealt at random into groups of bounded size.  A group is solved by
bin completion (Korf, 2002): best-fit decreasing gives the incumbent; branch
and bound then fills one sequence at a time around its largest piece with
undominated sets of others, fullest first, and turns back as soon as the waste
is more than one sequence fewer would allow.  The emptiest sequence of every
group goes back into the pool, which is dealt and solved again until one group
is left.

Defined results: a null or empty text is the end id alone; an empty table gives
an empty result; repeated rows are packed as often as they occur; a null id is
carried as null.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, released
from tessera.llm.textnum import slices
from tessera.llm.tokens import encoder

GROUP_ROWS = 3072


# ------------------------------------------------------------- one group


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes where the least room stays.  Gives indices."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    bins: list[list[int]] = []
    for i in order:
        k = bisect_left(room, (sizes[i], -1))
        if k == len(room):
            bins.append([i])
            left, b = capacity - sizes[i], len(bins) - 1
        else:
            left, b = room.pop(k)
            bins[b].append(i)
            left -= sizes[i]
        if left:
            insort(room, (left, b))
    return bins


def completions(pool: list[int], room: int, limit: int = 12, nodes: int = 400) -> list[tuple[int, ...]]:
    """Undominated sets of sizes from the sorted ``pool`` that fit ``room``, fullest first.

    A set is dominated when one of its sizes could be exchanged for a larger
    one of the pool, or another added, and still fit.
    """
    found: dict[tuple[int, ...], int] = {}
    left = [nodes]

    def extend(chosen: tuple[int, ...], free: int, below: int) -> bool:
        """Add sizes at positions under ``below``; true once a set fills the room."""
        top = min(bisect_right(pool, free), below)
        if not top:
            if chosen:
                found[chosen] = free
            return bool(chosen) and free == 0
        k, last, tried = top - 1, None, 0
        while k >= 0 and left[0] > 0 and tried < 6:
            size = pool[k]
            if size != last:
                left[0] -= 1
                tried += 1
                if free == size:
                    found[(*chosen, size)] = 0
                    return True
                if extend((*chosen, size), free - size, k):
                    return True
                last = size
            k = bisect_left(pool, size, 0, k) - 1
        return False

    extend((), room, len(pool))

    def dominated(sizes: tuple[int, ...], free: int) -> bool:
        return any(
            (k := bisect_right(pool, s)) < len(pool) and pool[k] <= s + free and pool[k] not in sizes for s in sizes
        )

    some = sorted((free, sizes) for sizes, free in found.items() if free == 0 or not dominated(sizes, free))
    return [sizes for _, sizes in some[:limit]] or [sizes for _, sizes in sorted((f, s) for s, f in found.items())[:limit]]


def _search(pool: list[int], capacity: int, allowed: int, nodes: int) -> list[tuple[int, ...]] | None:
    """Sequences of sizes for all of ``pool`` that waste at most ``allowed``, or None.

    Depth first; a frame holds the choices left for one sequence.
    """

    def options() -> Iterator[tuple[int, ...]]:
        largest = pool.pop()
        sets = completions(pool, capacity - largest)
        pool.append(largest)
        return iter([(largest, *s) for s in sets] or [(largest,)])

    filled, waste, frames = [], 0, [options()]
    while frames:
        taken = next((s for s in frames[-1] if waste + capacity - sum(s) <= allowed), None)
        if taken is None:
            frames.pop()
            if filled:
                undone = filled.pop()
                waste -= capacity - sum(undone)
                for size in undone:
                    insort(pool, size)
            continue
        filled.append(taken)
        waste += capacity - sum(taken)
        for size in taken:
            pool.pop(bisect_left(pool, size))
        if not pool:
            return filled
        nodes -= 1
        if nodes < 0:
            return None
        frames.append(options())
    return None


def pack(sizes: list[int], capacity: int, nodes: int = 3000) -> list[list[int]]:
    """Bins of indices, as few as best fit or ``nodes`` steps of branch and bound find."""
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    while len(best) > -(-total // capacity):
        filled = _search(sorted(sizes), capacity, (len(best) - 1) * capacity - total, nodes)
        if filled is None:
            break
        where: dict[int, list[int]] = {}
        for i, size in enumerate(sizes):
            where.setdefault(size, []).append(i)
        best = [[where[size].pop() for size in taken] for taken in filled]
    return best


# ------------------------------------------------------------------- Spark


def pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: the documents' pieces of at most ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                ids, at = enc.encode(b.column("text"), end_id)
                n = -(-np.diff(at) // capacity)
                row = np.repeat(np.arange(b.num_rows), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(at[row + 1] - at[row] - start, capacity)
                first = at[row] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(released(run), "id long, piece int, start long, length long, ids_crc32 long")


NAMES = ["id", "piece", "start", "length", "ids_crc32"]
PACKED = "id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


def _solver(capacity: int, base: int, reopen: bool):
    """A function that packs one group; ``reopen`` marks its emptiest sequence as open."""

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece"], kind="stable").reset_index(drop=True)
        sizes = rows["length"].tolist()
        bins = pack(sizes, capacity)
        seq, off, is_open = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        fill = [sum(sizes[i] for i in b) for b in bins]
        emptiest = int(np.argmin(fill)) if reopen and min(fill) < capacity else -1
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                seq[i], off[i], is_open[i] = base + (int(key[0]) << 24) + k, at, k == emptiest
                at += sizes[i]
        return rows[NAMES].assign(sequence_id=seq, offset=off, open=is_open)

    return solve


def pack_pieces(some: DataFrame, capacity: int = 4096, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces ``(id, piece, start, length, ids_crc32)``.

    Pieces are dealt to groups by a hash of their place in a table that is
    written first, so pieces that are equal, however many, are spread too.
    """
    pool, done = cut(some.select(*NAMES), "pieces"), []
    for round_no in range(12):
        n = pool.count()
        if not n:
            break
        groups = math.ceil(n / group_rows) if round_no < 11 else 1
        # ids travel as text: pandas would turn a nullable long into a double
        dealt = pool.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        dealt = dealt.withColumn("id", F.col("id").cast("string"))
        solved = dealt.groupBy("g").applyInPandas(_solver(capacity, round_no << 56, groups > 1), PACKED)
        packed = cut(solved.withColumn("id", F.col("id").cast("long")), f"packed{round_no}")
        done.append(packed.where("not open").drop("open"))
        if groups == 1:
            break
        pool = packed.where("open").select(*NAMES)
    if not done:
        return some.sparkSession.createDataFrame([], PACKED.replace("id string", "id long", 1)).drop("open")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
