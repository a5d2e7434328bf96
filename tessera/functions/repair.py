"""Rings that cross or touch themselves, rebuilt as valid ones.

A ring is cut where it meets itself.  Parts that it runs along there and back
cancel; the others are kept where they bound a place that the ring goes round
in the direction of its whole area, and are linked up to loops with that place
on their left.  So of a bow-tie the larger wing is left, a spike goes, and two
wings that touch in a point become two rings.  A valid ring stays as it is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.geometry import RING, signed_area
from tessera.functions.overlap import Rings

Point = tuple[float, float]
#: Points nearer than this share of a ring's extent are one.
NEAR = 1e-11


def loops(ring: list[Point]) -> list[list[Point]] | None:
    """The valid loops of a ring: outlines counter-clockwise, holes clockwise; None if it is valid as it is."""
    p = np.array([a for a, b in zip(ring, ring[-1:] + ring[:-1], strict=True) if a != b], float).reshape(-1, 2)
    if len(p) < 3:
        return []
    cuts = _meetings(p)
    if cuts is None:
        return None
    near = NEAR * max(np.ptp(p[:, 0]), np.ptp(p[:, 1]))
    ids: dict[tuple[int, int], int] = {}
    points: list[Point] = []

    def node(x: float, y: float) -> int:
        i, j = (round(v / near) for v in (x, y))
        for a in (i, i - 1, i + 1):
            for b in (j, j - 1, j + 1):
                if (a, b) in ids:
                    return ids[a, b]
        ids[i, j] = len(points)
        points.append((float(x), float(y)))
        return ids[i, j]

    corners = [node(x, y) for x, y in p]
    net: dict[tuple[int, int], int] = {}
    for k, (a, b) in enumerate(zip(p, np.roll(p, -1, 0), strict=True)):
        path = [corners[k], *[node(*(a + (b - a) * t)) for t in sorted(cuts[k])], corners[(k + 1) % len(p)]]
        for u, v in zip(path, path[1:], strict=False):
            if u != v:
                net[min(u, v), max(u, v)] = net.get((min(u, v), max(u, v)), 0) + (1 if u < v else -1)
    net = {e: n for e, n in net.items() if n}
    if not net:
        return []
    return _linked(_bounding(points, net), points, set(corners))


def _meetings(p: np.ndarray) -> list[list[float]] | None:
    """Shares of each edge at which it meets other edges or their corners; None if edges only meet at common corners."""
    n = len(p)
    a, d = p, np.roll(p, -1, 0) - p
    extent = max(np.ptp(p[:, 0]), np.ptp(p[:, 1]))
    cross = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    gap = a[None, :, :] - a[:, None, :]
    along = gap[..., 0] * d[None, :, 1] - gap[..., 1] * d[None, :, 0]  # of edge i where it meets the line of edge j
    length = np.hypot(d[:, 0], d[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = along / cross
    u = t.T  # the place on edge j is that of the swapped pair
    slack = NEAR * extent / length
    meets = (np.abs(cross) > 1e-14 * length[:, None] * length) & (t >= -slack[:, None]) & (t <= 1 + slack[:, None]) & (u >= -slack) & (u <= 1 + slack)
    cuts: list[list[float]] = [[] for _ in range(n)]
    touched = False
    for i, j in np.argwhere(meets):
        if i != j and not _corner(i, j, t[i, j], u[i, j], n, slack):
            cuts[i].append(float(t[i, j]))
            touched = True
    # corners that lie on another edge, also of one that runs the same way
    off = np.abs(d[:, None, 0] * (p[None, :, 1] - a[:, None, 1]) - d[:, None, 1] * (p[None, :, 0] - a[:, None, 0])) / length[:, None]
    where = ((p[None, :, :] - a[:, None, :]) * d[:, None, :]).sum(2) / (length**2)[:, None]
    for i, k in np.argwhere((off <= NEAR * extent) & (where > -slack[:, None]) & (where < 1 + slack[:, None])):
        if k not in (i, (i + 1) % n):
            touched = True
            if slack[i] < where[i, k] < 1 - slack[i]:
                cuts[i].append(float(where[i, k]))
    return cuts if touched else None


def _corner(i: int, j: int, t: float, u: float, n: int, slack: np.ndarray) -> bool:
    """Whether two edges only meet where one follows the other."""
    if j == (i + 1) % n:
        return t >= 1 - slack[i] and u <= slack[j]
    return i == (j + 1) % n and u >= 1 - slack[j] and t <= slack[i]


def _bounding(points: list[Point], net: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """The parts that bound what the ring goes round, with that on their left."""
    turn = 0.734  # no part is level after this turn, so that winding numbers can be told along x
    c, s = math.cos(turn), math.sin(turn)
    xy = np.array(points)
    x, y = c * xy[:, 0] - s * xy[:, 1], s * xy[:, 0] + c * xy[:, 1]
    e = np.array(list(net))
    up = y[e[:, 0]] < y[e[:, 1]]
    lo, hi = np.where(up, e[:, 0], e[:, 1]), np.where(up, e[:, 1], e[:, 0])
    rising = np.where(up, 1, -1) * np.array(list(net.values()))
    whole = (x[e[:, 0]] * y[e[:, 1]] - x[e[:, 1]] * y[e[:, 0]]) @ np.array(list(net.values()))
    sense = 1 if whole > 0 else -1
    out = []
    for k in range(len(e)):
        middle = (y[lo[k]] + y[hi[k]]) / 2
        over = (y[lo] < middle) & (y[hi] > middle)
        at = x[lo] + (x[hi] - x[lo]) * (middle - y[lo]) / np.where(over, y[hi] - y[lo], 1)
        over[k] = False
        left = -int(rising[over & (at < (x[lo[k]] + x[hi[k]]) / 2)].sum())
        right = left - int(rising[k])
        a, b = left * sense >= 1, right * sense >= 1
        if a != b:  # what is at the left of a part that rises lies at smaller x
            out.append((int(lo[k]), int(hi[k])) if a else (int(hi[k]), int(lo[k])))
    return out


def _linked(parts: list[tuple[int, int]], points: list[Point], corners: set[int]) -> list[list[Point]]:
    """Loops along parts; where several go on, the one that stays closest to the left is taken."""
    leaving: dict[int, list[int]] = {}
    for u, v in parts:
        leaving.setdefault(u, []).append(v)
    out = []
    while leaving:
        first = next(iter(leaving))
        path, at, back = [first], first, None
        while True:
            here = leaving[at]
            if back is None or len(here) == 1:
                nxt = here.pop(0)
            else:
                angle = lambda v: math.atan2(points[v][1] - points[at][1], points[v][0] - points[at][0])  # noqa: B023, E731
                nxt = min(here, key=lambda v: (angle(back) - angle(v)) % (2 * math.pi) or 2 * math.pi)  # noqa: B023
                here.remove(nxt)
            if not here:
                del leaving[at]
            back, at = at, nxt
            if at == first:
                break
            if at in path:  # a loop closed on the way
                k = path.index(at)
                out.append(path[k:])
                path = path[: k + 1]
                back = out[-1][-1]
                continue
            path.append(at)
        out.append(path)
    rings = []
    for loop in out:
        xy = [points[k] for k in loop]
        keep = [k in corners or _bends(a, b, c) for k, a, b, c in zip(loop, xy[-1:] + xy[:-1], xy, xy[1:] + xy[:1], strict=True)]
        ring = [q for q, k in zip(xy, keep, strict=True) if k]
        if len(ring) >= 3:
            rings.append(ring)
    return rings


def _bends(a: Point, b: Point, c: Point) -> bool:
    u, v = (b[0] - a[0], b[1] - a[1]), (c[0] - b[0], c[1] - b[1])
    return abs(u[0] * v[1] - u[1] * v[0]) > 1e-9 * math.hypot(*u) * math.hypot(*v)


def joined(rings: list[list[Point]]) -> list[Point]:
    """Loops as one ring, by ways there and back that enclose nothing."""
    out = list(rings[0]) if rings else []
    for r in rings[1:]:
        out = [out[0], *r, r[0], *out] if out else list(r)
    return out


#: Longer rings are worked out one by one.
SMALL_RING = 16
#: About so many pairs of edges are looked at at once.
EDGE_PAIRS = 1 << 19


def _without_ways_back(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rings ``(rings, corners)`` without points that repeat the one before and tips that are left the way they were reached.

    Points move to the front of their row; the third result is how many there
    are, the last whether a tip went.  A way there and back encloses nothing.
    """
    n, tips = np.full(len(x), x.shape[1]), np.zeros(len(x), bool)
    extent = np.maximum(np.ptp(x, 1), np.ptp(y, 1))[:, None]
    rows, at = np.arange(len(x))[:, None], np.arange(x.shape[1])
    for _ in range(2 * x.shape[1]):
        used = at < n[:, None]
        before, after = np.where(at > 0, at - 1, np.maximum(n[:, None] - 1, 0)), np.where(at + 1 < n[:, None], at + 1, 0)
        ax, ay, bx, by = x - x[rows, before], y - y[rows, before], x[rows, after] - x, y[rows, after] - y
        one, two = np.hypot(ax, ay), np.hypot(bx, by)
        same = used & (one == 0)
        # a tip: the shorter of its two ways lies on the longer one
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.abs(ax * by - ay * bx) / np.maximum(one, two)
        tip = used & (one > 0) & (two > 0) & (ax * bx + ay * by < 0) & (off <= NEAR * extent)
        gone = np.where(same.any(1, keepdims=True), same, tip)
        # one point of a ring at a time, since what is left of it depends on that
        gone &= np.cumsum(gone, 1) == 1
        if not gone.any():
            break
        tips |= (gone & ~same).any(1)
        order = np.argsort(~(used & ~gone), 1, kind="stable")
        x, y, n = x[rows, order], y[rows, order], n - gone.sum(1)
    return x, y, n, tips


def _states(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rings of one length: how many pairs of edges cross properly, a pair that does and the share of its first edge there; -1 where edges meet in another way."""
    n = x.shape[1]
    dx, dy = np.roll(x, -1, 1) - x, np.roll(y, -1, 1) - y
    extent = np.maximum(np.ptp(x, 1), np.ptp(y, 1))
    length = np.hypot(dx, dy)
    cross = dx[:, :, None] * dy[:, None] - dy[:, :, None] * dx[:, None]
    gx, gy = x[:, None] - x[:, :, None], y[:, None] - y[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gx * dy[:, None] - gy * dx[:, None]) / cross
        u = np.transpose(t, (0, 2, 1))
        slack = NEAR * extent[:, None] / length
        one, two = slack[:, :, None], slack[:, None]
        meets = (np.abs(cross) > 1e-14 * length[:, :, None] * length[:, None]) & (t >= -one) & (t <= 1 + one) & (u >= -two) & (u <= 1 + two)
        inside = meets & (t > 4 * one) & (t < 1 - 4 * one) & (u > 4 * two) & (u < 1 - 4 * two)
        off = np.abs(dx[:, :, None] * gy - dy[:, :, None] * gx) / length[:, :, None]
        where = (gx * dx[:, :, None] + gy * dy[:, :, None]) / (length**2)[:, :, None]
    i, j = np.arange(n)[:, None], np.arange(n)
    follows, leads = j == (i + 1) % n, i == (j + 1) % n
    corner = (follows & (t >= 1 - one) & (u <= two)) | (leads & (u >= 1 - two) & (t <= one))
    touched = meets & ~inside & ~corner & (i != j)
    on_edge = (off <= 4 * NEAR * extent[:, None, None]) & (where > -4 * one) & (where < 1 + 4 * one) & (j != i) & ~follows
    pairs = inside & (i < j)
    count = np.where((touched | on_edge | (inside & (follows | leads))).any((1, 2)) | ~(length > 0).all(1), -1, pairs.sum((1, 2)))
    first = pairs.reshape(len(x), -1).argmax(1)
    return count, first // n, first % n, t.reshape(len(x), -1)[np.arange(len(x)), first]


def _mended_all(x: np.ndarray, y: np.ndarray) -> list[list[list[Point]] | None | bool]:
    """``loops`` of rings of one length, False where a ring has to be worked out by itself.

    At once go valid rings, those that only run along ways there and back, and
    those of which just two edges cross: the crossing parts them into two
    loops, and what is gone round in the ring's direction is the larger one,
    whether they lie side by side or in each other.
    """
    out: list[list[list[Point]] | None | bool] = [False] * len(x)
    px, py, n, tips = _without_ways_back(x, y)
    for m in range(3, x.shape[1] + 1):
        rows = np.flatnonzero(n == m)
        if not len(rows):
            continue
        rx, ry = px[rows, :m], py[rows, :m]
        count, i, j, t = _states(rx, ry)
        nx, ny = np.roll(rx, -1, 1), np.roll(ry, -1, 1)
        terms = rx * ny - nx * ry
        whole = terms.sum(1)
        size = np.maximum(np.ptp(rx, 1), np.ptp(ry, 1)) ** 2
        sound = np.abs(whole) > 1e-9 * size
        for k in np.flatnonzero((count == 0) & sound).tolist():
            ring = list(zip(rx[k].tolist(), ry[k].tolist(), strict=True))
            # a valid ring stays as it is, with points that it repeats
            out[rows[k]] = [ring if whole[k] > 0 else ring[::-1]] if tips[rows[k]] else None
        k = np.flatnonzero((count == 1) & sound)
        k_, i, j, t = np.arange(len(k)), i[k], j[k], t[k]
        mx, my = rx[k, i] + (nx[k, i] - rx[k, i]) * t, ry[k, i] + (ny[k, i] - ry[k, i]) * t
        at = np.arange(m)
        between = (at > i[:, None]) & (at < j[:, None])
        cx, cy = rx[k], ry[k]
        ends = (mx * cy[k_, (i + 1) % m] - cx[k_, (i + 1) % m] * my) + (cx[k_, j] * my - mx * cy[k_, j])
        one = (terms[k] * between).sum(1) + ends
        two = whole[k] - one
        inner = (at > i[:, None]) & (at <= j[:, None])
        for q in k_[np.abs(np.abs(one) - np.abs(two)) > 1e-9 * size[k]].tolist():
            first = abs(one[q]) > abs(two[q])
            keep = np.flatnonzero(inner[q]) if first else np.concatenate([np.arange(j[q] + 1, m), np.arange(i[q] + 1)])
            ring = [(float(mx[q]), float(my[q])), *zip(cx[q, keep].tolist(), cy[q, keep].tolist(), strict=True)]
            out[rows[k[q]]] = [ring if (one[q] if first else two[q]) > 0 else [ring[0], *ring[:0:-1]]]
    return out


def _each(column: pa.Array):
    """Each ring's loops, or itself where it is valid; null where it is null."""
    r = Rings.of(column)
    fine = (r.n > 2) & r.counter_clockwise().convex() & (np.abs(r.signed_area()) > 0) & (r.n <= 4)
    null = np.asarray(column.is_null())
    found: list = [False] * len(r.n)
    for n in range(3, min(SMALL_RING, r.x.shape[1]) + 1):
        rows = np.flatnonzero(~fine & ~null & (r.n == n) & np.isfinite(r.x).all(1) & np.isfinite(r.y).all(1))
        step = max(1, EDGE_PAIRS // (n * n))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            for i, v in zip(some.tolist(), _mended_all(r.x[some, :n], r.y[some, :n]), strict=True):
                found[i] = v
    for i in range(len(r.n)):
        ring = list(zip(r.x[i, : r.n[i]].tolist(), r.y[i, : r.n[i]].tolist(), strict=True))
        if null[i]:
            yield None
        elif fine[i]:
            yield [ring]
        else:
            new = loops(ring) if found[i] is False else found[i]
            yield [ring] if new is None else new


_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_named = lambda ring: [{"x": x, "y": y} for x, y in ring]


def _one_ring(column: pa.Array) -> pa.Array:
    rings = [None if v is None else joined(v) if len(v) > 1 else v[0] if v else [] for v in _each(column)]
    points = np.array([p for v in rings if v for p in v], float).reshape(-1, 2)
    ends = np.append(0, np.cumsum([len(v) if v else 0 for v in rings])).astype(np.int32)
    xy = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(ends), xy, mask=pa.array([v is None for v in rings], pa.bool_()))


def _all_rings(column: pa.Array) -> pa.Array:
    return pa.array([None if v is None else [_named(r) for r in v] for v in _each(column)], pa.list_(_POINTS))


_RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
_one_udf = F.arrow_udf(_one_ring, _RING).asNondeterministic()
_all_udf = F.arrow_udf(_all_rings, T.ArrayType(_RING)).asNondeterministic()


def repaired(ring: Column) -> Column:
    """A ring that encloses what is valid of ``ring``, empty if nothing is; several loops are joined by ways of no width."""
    return _one_udf(ring.cast(RING))


def faces(ring: Column) -> Column:
    """The valid loops of a ring: outlines counter-clockwise, holes clockwise, a valid ring as it is."""
    return _all_udf(ring.cast(RING))


def repair_masks(masks: DataFrame) -> DataFrame:
    """Masks with valid rings: a ring becomes its loops; a hole in an outline is a hole, one in a hole an outline again.

    Loops that enclose nothing go, so a polygon may end with no ring.
    """
    f = masks.withColumn("__f", F.explode(faces(F.col("ring"))))
    first = F.when(F.size("__f") < 3, 0.0).otherwise(signed_area(F.col("__f")))
    f = f.withColumn("__a", first).where("__a <> 0")
    # a valid ring may go round either way; among several loops the direction tells holes from outlines
    inner = (F.col("__a") < 0) & (F.col("__f") != F.col("ring"))
    ring_id = F.when(inner & (F.col("ring_id") > 0), 0).when(inner & (F.col("ring_id") == 0), 1).otherwise(F.col("ring_id"))
    return f.withColumns({"ring_id": ring_id, "ring": F.col("__f")}).drop("__f", "__a")
