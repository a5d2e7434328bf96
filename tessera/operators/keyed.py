"""Keys of few rows, worked out whole where one shuffle brings their rows together.

Most images have some dozens of boxes.  Dealing these to cells, joining them,
and shuffling the pairs again moves every box many times.  A key of at most
``SMALL_KEY`` rows is taken as it comes off one shuffle instead, as a slice of
an Arrow table, and numpy compares its rows with each other.  Larger keys are
told apart by a count and go by cells and blocks, so no task holds one whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.overlap import Rings
from tessera.sources.scratch import settled

SMALL_KEY = 1024
#: About so many comparisons are made before their results are handed on.
COMPARED = 1 << 20
#: Pairs whose shared area is worked out at once.
PAIRS = 1 << 14


def by_size(rows: DataFrame, key: list[str], small: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys of at most ``small`` rows, and those of larger ones, None if there are none; rows without a key are the former."""
    large = large_keys(rows.select(*key), key, F.count("*") > (SMALL_KEY if small is None else small))
    return apart(rows, large, key)


def large_keys(rows: DataFrame, key: list[str], is_large: Column) -> DataFrame | None:
    """Keys of which the aggregate ``is_large`` holds, None if there are none."""
    large = rows.groupBy(*key).agg(is_large.alias("__large")).where("__large").select(*key).dropna()
    large = settled(large)
    return large if large.take(1) else None


def apart(rows: DataFrame, large: DataFrame | None, key: list[str]) -> tuple[DataFrame, DataFrame | None]:
    if large is None:
        return rows, None
    # a large key stands for many rows, so there are few of them
    return rows.join(F.broadcast(large), key, "left_anti"), rows.join(F.broadcast(large), key, "left_semi")


def together(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.repartition(*key).sortWithinPartitions(*key)


def flat(column: pa.ChunkedArray) -> pa.Array:
    c = column.combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)


def changes(t: pa.Table, key: list[str]) -> np.ndarray:
    """For each row but the first, whether its key is another than that of the row before; null is no key, so always another."""
    out = np.zeros(max(0, len(t) - 1), bool)
    for c in key if len(out) else ():
        v = flat(t.column(c))
        out |= pc.fill_null(pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)), True).to_numpy(zero_copy_only=False)
    return out


def whole(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Slices of whole keys, with each row's number of its key: a key that goes on in the next batch waits for it.

    Rows of a key stand together.  A slice has keys of about ``COMPARED`` pairs.
    """
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        new = np.flatnonzero(changes(t, key))
        end = int(new[-1]) + 1 if len(new) else 0
        rest = t.slice(end)
        if end:
            yield from _slices(t.slice(0, end), key)
    if rest is not None and len(rest):
        yield from _slices(rest, key)


def _slices(t: pa.Table, key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    group = np.append(0, np.cumsum(changes(t, key)))
    starts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(t))
    pairs = np.cumsum(np.diff(starts).astype(np.int64) ** 2)
    ends = starts[1:][np.append((pairs[1:] // COMPARED) != (pairs[:-1] // COMPARED), True)]
    at = 0
    for end in ends.tolist():
        yield t.slice(at, end - at).combine_chunks(), group[at:end]
        at = end


def ring_bounds(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``x0, y0, x1, y1`` of each ring, NaN where it is null or has no point."""
    rings = rings.fill_null([]) if rings.null_count else rings
    at = np.asarray(rings.offsets, np.int64)
    some = np.flatnonzero(np.diff(at) > 0)
    points = rings.flatten()
    out = [np.full(len(rings), np.nan) for _ in range(4)]
    if len(some):
        for k, axis in enumerate(("x", "y")):
            v = points.field(axis).to_numpy(zero_copy_only=False)
            for to, f in ((out[k], np.minimum), (out[k + 2], np.maximum)):
                to[some] = f.reduceat(v, at[some] - at[0])
    return tuple(out)


def touching(group: np.ndarray, box: tuple[np.ndarray, ...], side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers of a group, and of different sides, whose bounds touch, once each: a sweep along x in all groups at once."""
    x0, y0, x1, y1 = box
    real = np.flatnonzero(~np.isnan(x0 + y0 + x1 + y1))
    order = real[np.lexsort((x0[real], group[real]))]
    g, x0, y0, x1, y1 = (v[order] for v in (group, x0, y0, x1, y1))
    s = None if side is None else side[order]
    at = np.arange(len(order))
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(order)]
        to = at + step
        near = (g[to] == g[at]) & (x0[to] <= x1[at])
        at, to = at[near], to[near]
        hit = (y0[to] <= y1[at]) & (y0[at] <= y1[to])
        if s is not None:
            hit &= s[at] != s[to]
        if hit.any():
            yield order[at[hit]], order[to[hit]]


def gathered(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    found = list(pairs)
    return tuple(np.concatenate([p[k] for p in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def measured(f, a: pa.Array, b: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``f`` of the rings ``a[i]`` and ``b[j]``, in slices."""
    out = [f(Rings.of(a.take(pa.array(i[k : k + PAIRS]))), Rings.of(b.take(pa.array(j[k : k + PAIRS])))) for k in range(0, len(i), PAIRS)]
    return np.concatenate(out) if out else np.zeros(0)


def ranks(*columns: pa.Array) -> np.ndarray:
    """Each row's place in the order of the columns, equal for equal rows, nulls first."""
    dense = [np.asarray(pc.rank(c, "ascending", null_placement="at_start", tiebreaker="dense")).astype(np.int64) for c in columns]
    out = dense[0]
    for d in dense[1:]:
        out = out * (len(d) + 1) + d
        out = np.unique(out, return_inverse=True)[1]
    return out
