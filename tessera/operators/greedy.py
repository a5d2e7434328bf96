"""Greedy choices over pairs, in order, as sorted streams and rounds.

A greedy choice looks at candidates one by one and at what was chosen before.
Here candidates are rows, sorted by Spark within their key; a task walks along
the rows and remembers what it has decided of the current key, nothing else.  A
key with more than ``BLOCK_ROWS`` rows is cut into blocks by place, which are
walked along at once.  What depends on a candidate of another block waits; the
next round has only what waited.  The first undecided candidate of a key never
waits, so rounds end; they are as many as a chain of dependent candidates
changes blocks, one where no key is that large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import settled

BLOCK_ROWS = 1 << 17
#: A key is cut at quantiles of its places, into this many blocks at most.
MOST_BLOCKS = 256
YES, NO, WAITS = 0, 1, 2


def with_blocks(rows: DataFrame, key: list[str], place: str, block_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Add ``__block``, and tell whether any key has several."""
    block_rows = block_rows or BLOCK_ROWS
    large = rows.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > block_rows)
    if not large.take(1):
        return rows.withColumn("__block", F.lit(0)), False
    cuts = rows.join(large, key).groupBy(*key).agg(
        F.least(F.ceil(F.max("__n") / block_rows), F.lit(MOST_BLOCKS)).alias("__parts"),
        F.percentile_approx(place, [k / MOST_BLOCKS for k in range(1, MOST_BLOCKS)], 10000).alias("__cuts"),
    )
    step = F.size(F.filter("__cuts", lambda c: c < F.col(place)))
    block = F.floor(step * F.col("__parts") / MOST_BLOCKS).cast("int")
    return settled(rows.join(cuts, key, "left").withColumn("__block", F.coalesce(block, F.lit(0))).drop("__parts", "__cuts")), True


def _walk(rows: DataFrame, key: list[str], order: list, columns: list[str], start: Callable[[], Callable[..., int]]) -> DataFrame:
    """Rows with ``__state``: what a function made by ``start`` says of ``columns``, row by row in order, one for each key and block."""
    group = [*key, "__block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, say = None, None
        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in group), strict=True)
            state = []
            for at, *values in zip(keys, *(b.column(c).to_pylist() for c in columns), strict=True):
                if at != now:
                    now, say = at, start()
                state.append(say(*values))
            yield b.append_column("__state", pa.array(state, pa.int32()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", __state int"
    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def _suppressor() -> Callable[..., int]:
    fallen: dict = {}  # NO where it has fallen, WAITS where that is open; others stay

    def say(first: int, second: int, outside: bool) -> int:
        what = WAITS if outside else fallen.get(first, YES)
        if what == YES:
            fallen[second] = NO
        elif what == WAITS and fallen.get(second) != NO:
            fallen[second] = WAITS
        return what

    return say


def fallen(edges: DataFrame, key: list[str], rank: str, place: str, block_rows: int | None = None) -> DataFrame:
    """``(*key, second)``: what falls, if in order everything that stays fells those behind it.

    ``edges`` has ``first, second`` for candidates of which the first comes
    before the second and fells it if it stays; ``rank`` and ``second`` order
    the second ones, ``place`` tells where they are.
    """
    now, several = with_blocks(settled(edges.select(*key, "first", "second", rank, place)), key, place, block_rows)
    out = None
    while True:
        rows = now.withColumn("__outside", F.lit(False))
        if several:
            held = now.select(*key, F.col("second").alias("first"), F.col("__block").alias("__of")).distinct()
            elsewhere = F.col("__of").isNotNull() & (F.col("__of") != F.col("__block"))
            rows = now.join(held, [*key, "first"], "left").withColumn("__outside", elsewhere).drop("__of")
        said = _walk(rows, key, [rank, "second"], ["first", "second", "__outside"], _suppressor)
        if not several:
            return said.where(F.col("__state") == YES).select(*key, "second").distinct()
        said = settled(said)
        felled = said.where(F.col("__state") == YES).select(*key, "second").distinct()
        out = felled if out is None else out.unionByName(felled)
        # neither what has fallen nor what it would have felled waits any longer
        now = said.where(F.col("__state") == WAITS).drop("__state", "__outside").join(felled, [*key, "second"], "left_anti")
        now = settled(now.join(felled.withColumnRenamed("second", "first"), [*key, "first"], "left_anti"))
        if not now.take(1):
            return out


def _pairer() -> Callable[..., int]:
    taken: tuple[set, set] = set(), set()
    open_: tuple[set, set] = set(), set()

    def say(p: int, t: int, waits: bool) -> int:
        if p in taken[0] or t in taken[1]:
            return NO
        what = WAITS if waits or p in open_[0] or t in open_[1] else YES
        for seen, v in zip(open_ if what == WAITS else taken, (p, t), strict=True):
            seen.add(v)
        return what

    return say


def paired(pairs: DataFrame, key: list[str], order: list[str], place: str, block_rows: int | None = None) -> DataFrame:
    """The rows of ``pairs`` that are taken, if in ``order`` each is taken whose ``p`` and ``t`` are both free.

    ``place`` is that of ``t``: rows that share it are in one block.
    """
    now, several = with_blocks(settled(pairs), key, place, block_rows)
    out = None
    while True:
        rows = now.withColumn("__waits", F.lit(False))
        if several:
            by = F.struct(*order)
            ends = now.groupBy(*key, "p").agg((F.min("__block") < F.max("__block")).alias("__spans"), F.min(by).alias("__lead"))
            rows = now.join(ends, [*key, "p"]).withColumn("__waits", F.col("__spans") & (by != F.col("__lead"))).drop("__spans", "__lead")
        said = _walk(rows, key, order, ["p", "t", "__waits"], _pairer)
        if not several:  # written, since both sides of a matching look it up
            return settled(said.where(F.col("__state") == YES).select(*pairs.columns))
        said = settled(said)
        took = said.where(F.col("__state") == YES)
        out = took.select(*pairs.columns) if out is None else out.unionByName(took.select(*pairs.columns))
        now = said.where(F.col("__state") == WAITS).drop("__state", "__waits")
        for side in ("p", "t"):
            now = now.join(took.select(*key, side), [*key, side], "left_anti")
        now = settled(now)
        if not now.take(1):
            return out
