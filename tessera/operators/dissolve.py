"""Mask polygons as disjoint pieces, worked out cell by cell.

A mask may have millions of edges, so no step holds all of them.  Edges are cut
at the lines of a grid and dealt to its cells.  What a cell has to know of the
rest of the mask is one number, how many polygons cover its lower left corner:
edges that cross the lower line of a row of cells change that number from cell
to cell, and a window adds them up.  Within a cell edges are swept by slabs.
Between two cells of a row that have edges all cells are covered alike, so they
become one rectangle.

Masks of few edges, which most are, are taken whole off one shuffle and cut up
in memory; the others are cut and swept by Spark, cell by cell.

Outlines count once where they go round counter-clockwise, holes the other way,
and rings are turned that way first; so the sum of winding numbers tells how
many polygons cover a place, and edges that two neighbours share cancel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.geometry import bounds, rectangle, signed_area
from tessera.functions.overlap import RING
from tessera.operators import keyed
from tessera.sources.scratch import settled

#: About so many edges lie in a cell of a mask whose edges are spread evenly.
CELL_EDGES = 64
#: About so many pieces of small masks are swept at once, and so many at most are one small mask's.
PIECES, PIECES_OF_ONE = 1 << 16, 1 << 12
MASK = ["image", "kind"]
CELL = [*MASK, "row", "col"]


def _edges(masks: DataFrame) -> DataFrame:
    """Directed edges ``x0, y0, x1, y1`` of all rings, turned as the sum of windings needs it."""
    r = F.col("ring")
    wrong = (signed_area(r) < 0) != (F.col("ring_id") > 0)
    rings = masks.where(F.size(r) >= 3).select(*MASK, F.when(wrong, F.reverse(r)).otherwise(r).alias("ring"))
    ends = F.arrays_zip(F.col("ring").alias("p"), F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1)).alias("q"))
    e = rings.select(*MASK, F.explode(ends).alias("e"))
    named = {"x0": "e.p.x", "y0": "e.p.y", "x1": "e.q.x", "y1": "e.q.y"}
    return e.select(*MASK, *[F.col(v).alias(k) for k, v in named.items()]).where("x0 <> x1 or y0 <> y1")


def _grids(masks: DataFrame, cell: float | None) -> DataFrame:
    """``ox, oy, side`` of each mask's grid, from its lower corner on."""
    b = masks.select(*MASK, F.size("ring").alias("n"), bounds(F.col("ring")).alias("b")).groupBy(*MASK)
    g = b.agg(F.min("b.x0").alias("ox"), F.min("b.y0").alias("oy"), F.max("b.x1").alias("mx"), F.max("b.y1").alias("my"), F.sum("n").alias("n"))
    extent = F.greatest(F.col("mx") - F.col("ox"), F.col("my") - F.col("oy"))
    # a little more than the extent, so that a mask of few edges is one cell
    side = F.lit(float(cell)) if cell else extent * 1.0625 / F.greatest(F.lit(1.0), F.sqrt(F.col("n") / CELL_EDGES))
    return g.select(*MASK, "ox", "oy", side.alias("side")).where("side > 0")


def _cut(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, ox: np.ndarray, oy: np.ndarray, side: np.ndarray) -> dict[str, np.ndarray]:
    """Pieces of edges by cell: ends, and whether they cross the cell's lower line or run along its left one; ``of`` is the edge.

    Ends on a line have exactly its coordinate, so the same line is met by the
    pieces of both its sides.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        of, at, line, axis = [np.arange(len(x0))] * 2, [np.zeros(len(x0)), np.ones(len(x0))], [np.full(len(x0), np.nan)] * 2, [np.full(len(x0), -1)] * 2
        for k, (p, q, o) in enumerate(((x0, x1, ox), (y0, y1, oy))):
            lo, hi = np.minimum(p, q), np.maximum(p, q)
            first, last = np.floor((lo - o) / side).astype(np.int64) + 1, np.ceil((hi - o) / side).astype(np.int64) - 1
            n = np.where(p != q, np.maximum(0, last - first + 1), 0)
            row = np.repeat(np.arange(len(p)), n)
            number = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            where = o[row] + number * side[row]
            inside = (where > lo[row]) & (where < hi[row])
            row, where = row[inside], where[inside]
            of.append(row)
            at.append((where - p[row]) / (q[row] - p[row]))
            line.append(where)
            axis.append(np.full(len(row), k))
    of, at, line, axis = map(np.concatenate, (of, at, line, axis))
    order = np.lexsort((at, of))
    of, at, line, axis = of[order], at[order], line[order], axis[order]
    x, y = x0[of] + (x1 - x0)[of] * at, y0[of] + (y1 - y0)[of] * at
    x, y = np.where(axis == 0, line, np.where(at == 1, x1[of], x)), np.where(axis == 1, line, np.where(at == 1, y1[of], y))
    two = np.flatnonzero(of[1:] == of[:-1])
    of, xa, ya, xb, yb = of[two], x[two], y[two], x[two + 1], y[two + 1]
    some = (xa != xb) | (ya != yb)
    of, xa, ya, xb, yb = (v[some] for v in (of, xa, ya, xb, yb))
    col, row = (np.floor(((a + c) / 2 - o[of]) / side[of]).astype(np.int64) for a, c, o in ((xa, xb, ox), (ya, yb, oy)))
    # the middle of a piece tells its cell, unless it is a rounding error away from a line
    left, low = ox[of] + col * side[of], oy[of] + row * side[of]
    rises = np.where((np.minimum(ya, yb) == low) & (ya != yb), np.where(ya < yb, -1, 1), 0)
    along = (xa == left) & (xb == left)
    return {
        "of": of, "row": row, "col": col, "xa": xa, "ya": ya, "xb": xb, "yb": yb, "left": left, "low": low, "side": side[of],
        "rises": np.where(along, 0, rises), "before": np.where(along, rises, 0), "along": along,
    }


def _cut_at_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = _cut(*(b.column(k).to_numpy() for k in ("x0", "y0", "x1", "y1", "ox", "oy", "side")))
        of = pa.array(p.pop("of"))
        yield pa.RecordBatch.from_arrays([b.column("image").take(of), b.column("kind").take(of), *map(pa.array, p.values())], [*MASK, *p])


def _swept(
    xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray, base: int, left: float, low: float, side: float
) -> list[tuple[float, ...]]:
    """Corners of trapezoids ``x, y, ...`` that cover what a cell's pieces enclose."""
    top, right = low + side, left + side
    # the left border carries what covers it: at its foot, and from where edges leave it on
    leaves = (np.minimum(xa, xb) == left) & (xa != xb)
    y_left = np.where(xa == left, ya, yb)[leaves]
    turns = np.where(xa == left, 1, -1)[leaves]
    y_left, turns = y_left[y_left > low], turns[y_left > low]  # what happens at the foot is in the base
    some = ya != yb
    up = ya < yb
    x0, y0, x1, y1 = (v[some] for v in (np.where(up, xa, xb), np.where(up, ya, yb), np.where(up, xb, xa), np.where(up, yb, ya)))
    weight = np.where(up, -1, 1)[some]
    border = [np.full(len(y_left) + 1, v) for v in (left, top)]
    x0, x1 = np.concatenate([border[0], x0]), np.concatenate([border[0], x1])
    y0, y1 = np.concatenate([[low], y_left, y0]), np.concatenate([border[1], y1])
    weight = np.concatenate([[base], turns, weight])
    real = (weight != 0) & (y0 < y1)
    x0, y0, x1, y1, weight = (v[real] for v in (x0, y0, x1, y1, weight))
    if not len(x0):
        return []
    slope = (x1 - x0) / (y1 - y0)
    at = lambda e, y: x0[e] + slope[e] * (y - y0[e])
    every = np.arange(len(x0))
    lo, hi = np.maximum(y0[:, None], y0), np.minimum(y1[:, None], y1)
    d0, d1 = (at(every[:, None], y) - at(every, y) for y in (lo, hi))
    cross = (lo < hi) & (d0 * d1 < 0)
    levels = np.unique(np.concatenate([y0, y1, lo[cross] + (hi[cross] - lo[cross]) * d0[cross] / (d0[cross] - d1[cross])]))
    out = []
    for a, b in zip(levels[:-1].tolist(), levels[1:].tolist(), strict=True):
        e = np.flatnonzero((y0 <= a) & (y1 >= b))
        e = e[np.argsort(at(e, (a + b) / 2), kind="stable")]
        full = np.concatenate([[False], np.cumsum(weight[e]) > 0])
        change = np.flatnonzero(full[1:] != full[:-1])
        for k in range(0, len(change), 2):
            i = e[change[k]]
            j = e[change[k + 1]] if k + 1 < len(change) else None
            ends = at(i, a), right if j is None else at(j, a), at(i, b), right if j is None else at(j, b)
            if ends[1] > ends[0] or ends[3] > ends[2]:
                out.append((ends[0], a, ends[1], a, ends[3], b, ends[2], b))
    return out


def _swept_all(p: dict[str, np.ndarray], of: np.ndarray, cells: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The trapezoids of many cells at once: each one's cell, and its corners as ``_swept`` makes them.

    ``of`` is the cell of each piece, in order.  Cells of some dozens of pieces
    are worked out as padded matrices, larger ones by themselves.
    """
    count = len(cells["base"])
    left, low, side, base = (cells[k] for k in ("left", "low", "side", "base"))
    top, right = low + side, left + side
    xa, ya, xb, yb = (p[k] for k in ("xa", "ya", "xb", "yb"))
    leaves = (np.minimum(xa, xb) == left[of]) & (xa != xb)
    y_left = np.where(xa == left[of], ya, yb)
    leaves &= y_left > low[of]
    up = ya < yb
    at_left = left[of][leaves]
    x0, x1 = (np.concatenate([left, at_left, v]) for v in (np.where(up, xa, xb), np.where(up, xb, xa)))
    y0 = np.concatenate([low, y_left[leaves], np.where(up, ya, yb)])
    y1 = np.concatenate([top, top[of][leaves], np.where(up, yb, ya)])
    weight = np.concatenate([base, np.where(xa == left[of], 1, -1)[leaves], np.where(up, -1, 1)])
    cell = np.concatenate([np.arange(count), of[leaves], of])
    real = np.flatnonzero((weight != 0) & (y0 < y1))
    real = real[np.argsort(cell[real], kind="stable")]
    x0, y0, x1, y1, weight, cell = (v[real] for v in (x0, y0, x1, y1, weight, cell))
    n = np.bincount(cell, minlength=count)
    start = np.cumsum(n) - n
    found: list[tuple[np.ndarray, np.ndarray]] = []
    few = np.flatnonzero((n > 0) & (n <= CELL_EDGES))
    few = few[np.argsort(n[few], kind="stable")]
    at = 0
    while at < len(few):
        # so many cells that their matrices of places, slabs and edges stay small
        size = 1 << int(n[few[at]] - 1).bit_length() if n[few[at]] > 1 else 1
        some = few[at : at + max(1, (1 << 21) // (size * size * (size // 2 + 2)))]
        some = some[n[some] <= size]
        at += len(some)
        index = start[some][:, None] + np.arange(size)
        pad = np.arange(size) >= n[some][:, None]
        index = np.where(pad, 0, index)
        take = lambda v, else_: np.where(pad, else_, v[index])  # noqa: B023, E731
        found.append(_slabs(take(x0, 0.0), take(y0, np.inf), take(x1, 0.0), take(y1, -np.inf), take(weight, 0), some, right[some]))
    for c in np.flatnonzero(n > CELL_EDGES).tolist():
        i, j = np.searchsorted(of, [c, c + 1])
        traps = _swept(xa[i:j], ya[i:j], xb[i:j], yb[i:j], int(base[c]), left[c], low[c], side[c])
        found.append((np.full(len(traps), c), np.array(traps, float).reshape(-1, 8)))
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, 8))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _slabs(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, weight: np.ndarray, cell: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trapezoids of cells with edges ``(cells, edges)``; an edge that only fills up has no weight and no height."""
    with np.errstate(invalid="ignore", divide="ignore"):
        slope = np.where(np.isfinite(y0), (x1 - x0) / (y1 - y0), 0.0)
        foot = np.where(np.isfinite(y0), y0, 0.0)
        lo, hi = np.maximum(y0[:, :, None], y0[:, None]), np.minimum(y1[:, :, None], y1[:, None])
        meet = lo < hi
        d0, d1 = ((x0[:, :, None] + slope[:, :, None] * (y - foot[:, :, None])) - (x0[:, None] + slope[:, None] * (y - foot[:, None])) for y in (lo, hi))
        cross = meet & (d0 * d1 < 0)
        crossings = np.where(cross, lo + (hi - lo) * d0 / (d0 - d1), np.inf).reshape(len(cell), -1)
        levels = np.sort(np.concatenate([y0, np.where(np.isfinite(y1), y1, np.inf), crossings], 1), 1)
        levels[:, 1:][levels[:, 1:] == levels[:, :-1]] = np.inf
        levels = np.sort(levels, 1)[:, : max(2, int(np.isfinite(levels).sum(1).max(initial=0)))]
        a, b = levels[:, :-1], levels[:, 1:]
        runs = (y0[:, None] <= a[:, :, None]) & (y1[:, None] >= b[:, :, None]) & np.isfinite(b)[:, :, None]
        middle = x0[:, None] + slope[:, None] * (((a + b) / 2)[:, :, None] - foot[:, None])
    order = np.argsort(np.where(runs, middle, np.inf), 2, kind="stable")
    weighed = np.take_along_axis(np.where(runs, weight[:, None], 0), order, 2)
    full = np.cumsum(weighed, 2) > 0
    change = full.copy()
    change[:, :, 1:] = full[:, :, 1:] != full[:, :, :-1]
    c, s, e = np.nonzero(change)
    begins = np.flatnonzero(full[c, s, e])
    ends = begins + 1
    closed = ends < len(c)
    ends = np.where(closed, ends, 0)
    closed &= (c[ends] == c[begins]) & (s[ends] == s[begins]) if len(c) else closed
    k, slab = c[begins], s[begins]
    i, j = order[k, slab, e[begins]], order[k, slab, e[ends]]
    at = lambda v, y: x0[k, v] + slope[k, v] * (y - foot[k, v])
    ya, yb = a[k, slab], b[k, slab]
    xs = at(i, ya), np.where(closed, at(j, ya), right[k]), at(i, yb), np.where(closed, at(j, yb), right[k])
    wide = (xs[1] > xs[0]) | (xs[3] > xs[2])
    return cell[k[wide]], np.stack([xs[0], ya, xs[1], ya, xs[3], yb, xs[2], yb], 1)[wide]


def _rings_of(corners: np.ndarray) -> pa.Array:
    xy = corners.reshape(-1, 2)
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(corners) + 1, dtype=np.int32) * 4), points)


def pieces_of(mask: np.ndarray, rings: pa.Array, ring_id: pa.Array, cell: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """``mask, row, col, ring`` of whole masks, of which ``mask`` tells each ring's: what ``dissolve`` makes of them."""
    rings = rings.fill_null([]) if rings.null_count else rings
    at = np.asarray(rings.offsets, np.int64)
    at, points = at - at[0], rings.flatten()
    x, y = (points.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y"))
    n = np.diff(at)
    ring = np.repeat(np.arange(len(n)), n)
    if not len(ring):
        return
    masks, of = np.unique(mask[ring], return_inverse=True)
    low, high = np.full((2, len(masks)), np.inf), np.full((2, len(masks)), -np.inf)
    for k, v in enumerate((x, y)):
        np.minimum.at(low[k], of, v)
        np.maximum.at(high[k], of, v)
    extent = (high - low).max(0)
    edges = np.bincount(of, minlength=len(masks))
    side = np.full(len(masks), float(cell)) if cell else extent * 1.0625 / np.maximum(1.0, np.sqrt(edges / CELL_EDGES))
    after = np.where(np.arange(1, len(ring) + 1) == at[ring + 1], at[ring], np.arange(1, len(ring) + 1))
    twice = np.zeros(len(n))
    np.add.at(twice, ring, x * y[after] - x[after] * y)
    hole = np.asarray(pc.fill_null(pc.greater(ring_id, 0), False))
    back = ((twice < 0) != hole)[ring]
    p, q = np.where(back, after, np.arange(len(ring))), np.where(back, np.arange(len(ring)), after)
    real = (n[ring] >= 3) & ((x[p] != x[q]) | (y[p] != y[q])) & (side[of] > 0)
    p, q, of = p[real], q[real], of[real]
    # masks are cut up some at a time, by about how many pieces their edges make
    with np.errstate(divide="ignore", invalid="ignore"):
        load = np.cumsum((2 + np.where(side > 0, extent / side, 0.0)) * edges) // PIECES
    for part in np.unique(load):
        e = np.flatnonzero(load[of] == part)
        if len(e):
            m = of[e]
            got, row, col, rings_ = _pieces_of_masks(m, *(v[e] for v in (x[p], y[p], x[q], y[q])), low[0][m], low[1][m], side[m])
            yield masks[got], row, col, rings_


def _pieces_of_masks(mask: np.ndarray, *edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    p = _cut(*edges)
    owner = mask[p["of"]]
    order = np.lexsort((p["col"], p["row"], owner))
    p = {k: v[order] for k, v in p.items()}
    owner = owner[order]
    if not len(owner):
        return owner, p["row"], p["col"], _rings_of(np.zeros((0, 8)))
    row_first = np.append(True, (owner[1:] != owner[:-1]) | (p["row"][1:] != p["row"][:-1]))
    first = row_first | np.append(True, p["col"][1:] != p["col"][:-1])
    start, cell = np.flatnonzero(first), np.cumsum(first) - 1
    rises, before = (np.add.reduceat(p[k], start) for k in ("rises", "before"))
    so_far = np.cumsum(rises + before) - rises - before
    line = np.cumsum(row_first[start]) - 1
    so_far = so_far - so_far[np.flatnonzero(row_first[start])][line]
    cells = {k: p[k][start] for k in ("left", "low", "side", "row", "col")} | {"base": so_far + before}
    inner = ~p["along"]
    of, corners = _swept_all({k: p[k][inner] for k in ("xa", "ya", "xb", "yb")}, cell[inner], cells)
    # cells between two of a row that have edges are covered alike
    i = np.flatnonzero((line[1:] == line[:-1]) & ((cells["base"] + rises)[:-1] > 0) & (cells["col"][1:] > cells["col"][:-1] + 1))
    x, y, s = cells["left"][i] + cells["side"][i], cells["low"][i], cells["side"][i]
    far = cells["left"][i] + s * (cells["col"][i + 1] - cells["col"][i])
    across = np.stack([x, y, far, y, far, y + s, x, y + s], 1)
    owner = owner[start]
    named = [np.concatenate([v[of], v[i] + add]) for v, add in ((owner, 0), (cells["row"], 0), (cells["col"], 1))]
    return *named, _rings_of(np.concatenate([corners, across]))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each cell, whose rows stand together: a cell that goes on in the next batch waits for it."""
    rest: pa.Table | None = None

    def done(t: pa.Table) -> pa.RecordBatch:
        starts = np.append(0, np.flatnonzero(_new(t)) + 1)
        ends = np.append(starts[1:], len(t))
        get = {k: t.column(k).to_numpy() for k in ("xa", "ya", "xb", "yb", "base", "left", "low", "side")}
        inner = ~t.column("along").to_numpy()
        cell = np.repeat(np.arange(len(starts)), ends - starts)
        of, corners = _swept_all({k: get[k][inner] for k in ("xa", "ya", "xb", "yb")}, cell[inner], {k: get[k][starts] for k in ("base", "left", "low", "side")})
        rings = _rings_of(corners)
        head = t.select(CELL).take(pa.array(starts[of])).combine_chunks()
        return pa.RecordBatch.from_arrays([*(_flat(head.column(c)) for c in CELL), rings], [*CELL, "ring"])

    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])]).combine_chunks()
        new = np.flatnonzero(_new(t))
        whole = int(new[-1]) + 1 if len(new) else 0
        rest = t.slice(whole).combine_chunks()
        if whole:
            yield done(t.slice(0, whole).combine_chunks())
    if rest is not None and len(rest):
        yield done(rest)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    c = column.combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)


def _new(t: pa.Table) -> np.ndarray:
    """For each row but the first, whether it is of another cell than the one before."""
    out = np.zeros(max(0, len(t) - 1), bool)
    for c in CELL if len(out) else ():
        v = _flat(t.column(c))
        out |= pc.fill_null(pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)), False).to_numpy(zero_copy_only=False)
    return out


def dissolve(masks: DataFrame, cell: float | None = None) -> DataFrame:
    """``image, kind, row, col, ring``: disjoint convex pieces that cover the union of each mask's polygons.

    ``masks`` has ``image, kind, polygon_id, ring_id, ring`` with simple rings
    (``repair`` mends others).  The grid's side follows from a mask's extent and
    number of edges, or is ``cell``.  Rings of fewer than three points count for
    nothing.
    """
    masks = masks.select(*MASK, "ring_id", F.col("ring").cast(RING).alias("ring")).dropna(subset=MASK)
    b = masks.withColumns({"__n": F.size("ring"), "__b": bounds(F.col("ring"))})
    edges, extent = F.sum("__n"), F.greatest(F.max("__b.x1") - F.min("__b.x0"), F.max("__b.y1") - F.min("__b.y0"))
    is_large = (edges > CELL_EDGES) | (F.coalesce(edges * extent / cell, F.lit(0.0)) > PIECES_OF_ONE if cell else F.lit(False))
    few, many = keyed.apart(masks, keyed.large_keys(b, MASK, is_large), MASK)
    types = dict(masks.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in MASK) + f", row long, col long, ring {RING}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in keyed.whole(batches, MASK):
            for mask, row, col, rings in pieces_of(group, keyed.flat(t.column("ring")), keyed.flat(t.column("ring_id")), cell):
                head = t.select(MASK).take(pa.array(np.searchsorted(group, mask)))
                yield pa.RecordBatch.from_arrays([*(keyed.flat(head.column(c)) for c in MASK), pa.array(row), pa.array(col), rings], [*CELL, "ring"])

    found = keyed.together(few, MASK).mapInArrow(run, schema)
    return found if many is None else found.unionByName(_dissolve_large(many, cell))


def _dissolve_large(masks: DataFrame, cell: float | None) -> DataFrame:
    edges = _edges(masks).join(_grids(masks, cell), MASK)
    types = dict(masks.dtypes)
    names = ", ".join(f"{c} {types[c]}" for c in MASK)
    pieces = settled(edges.mapInArrow(
        _cut_at_lines,
        f"{names}, row long, col long, xa double, ya double, xb double, yb double, left double, low double, side double, rises long, before long, along boolean",
    ))
    cells = pieces.groupBy(*CELL).agg(
        F.sum("rises").alias("rises"), F.sum("before").alias("before"), F.first("left").alias("left"), F.first("low").alias("low"), F.first("side").alias("side")
    )
    line = Window.partitionBy(*MASK, "row").orderBy("col")
    so_far = F.coalesce(F.sum(F.col("rises") + F.col("before")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = settled(cells.select(*CELL, "left", "low", "side", (so_far + F.col("before")).alias("base"), (so_far + F.col("before") + F.col("rises")).alias("after"), F.lead("col").over(line).alias("next")))
    ready = pieces.join(cells.select(*CELL, "base"), CELL).repartition(*CELL).sortWithinPartitions(*CELL)
    swept = ready.mapInArrow(_sweep, f"{names}, row long, col long, ring {RING}")
    x, y = F.col("left") + F.col("side"), F.col("low")
    across = rectangle(x, y, F.col("left") + F.col("side") * (F.col("next") - F.col("col")), y + F.col("side"))
    between = cells.where("after > 0 and next > col + 1").select(*MASK, "row", (F.col("col") + 1).alias("col"), across.alias("ring"))
    return swept.unionByName(between)
