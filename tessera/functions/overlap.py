"""Areas that two rings share, over whole Arrow batches of pairs.

Clipping walks from corner to corner and keeps a list that grows and shrinks,
which Catalyst can only interpret, about a millisecond a pair.  Here a batch of
pairs is clipped at once: one numpy step for each edge of the window.  Pairs
whose window isn't convex are worked out by slabs instead, so any two simple
rings may meet.  Nothing is kept between batches.

The functions are declared non-deterministic although they are not: the
optimizer would otherwise copy them from a projection into the filters behind
it, and evaluate each pair twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions.geometry import RING


class Rings:
    """Rings of different lengths as padded matrices ``x, y`` with their lengths ``n``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray):
        self.x, self.y, self.n = x, y, n

    @classmethod
    def of(cls, column: pa.Array) -> Rings:
        """Of a list column of points; a null list is a ring without points."""
        column = column.fill_null([]) if column.null_count else column
        at = np.asarray(column.offsets, np.int64)
        n = np.diff(at)
        points = column.flatten()
        inside = np.arange(n.max(initial=0)) < n[:, None]
        out = []
        for axis in ("x", "y"):
            m = np.zeros(inside.shape)
            m[inside] = points.field(axis).to_numpy(zero_copy_only=False)
            out.append(m)
        return cls(*out, n)

    def __getitem__(self, rows: np.ndarray) -> Rings:
        n = self.n[rows]
        width = n.max(initial=0)
        return Rings(self.x[rows, :width], self.y[rows, :width], n)

    def next(self, m: np.ndarray) -> np.ndarray:
        """Each place's successor around its ring."""
        width = m.shape[1]
        at = np.arange(width) + 1
        return np.take_along_axis(m, np.where(at < self.n[:, None], at, 0), 1) if width else m

    def inside(self) -> np.ndarray:
        return np.arange(self.x.shape[1]) < self.n[:, None]

    def signed_area(self) -> np.ndarray:
        """Shoelace areas, added corner by corner; 0 for fewer than three."""
        terms = np.where(self.inside(), self.x * self.next(self.y) - self.next(self.x) * self.y, 0.0)
        total = np.zeros(len(self.n))
        for k in range(terms.shape[1]):
            total += terms[:, k]
        return np.where(self.n < 3, 0.0, total / 2.0)

    def counter_clockwise(self) -> Rings:
        turn = self.signed_area() < 0
        at = np.arange(self.x.shape[1])
        order = np.where(turn[:, None] & self.inside(), self.n[:, None] - 1 - at, at)
        return Rings(np.take_along_axis(self.x, order, 1), np.take_along_axis(self.y, order, 1), self.n)

    def convex(self) -> np.ndarray:
        """Whether a counter-clockwise ring never turns right and goes round once."""
        dx, dy = self.next(self.x) - self.x, self.next(self.y) - self.y
        turn = dx * self.next(dy) - dy * self.next(dx)
        scale = np.abs(dx).max(1, initial=0) ** 2 + np.abs(dy).max(1, initial=0) ** 2
        right = (turn < -1e-9 * scale[:, None]) & self.inside()
        # a ring that goes round once changes its direction along each axis twice at most
        ups = [np.where(self.inside(), np.sign(d), 0) for d in (dx, dy)]
        changes = [((u != self.next(u)) & (u > 0) & self.inside()).sum(1) for u in ups]
        return ~right.any(1) & (changes[0] <= 1) & (changes[1] <= 1)


def clipped(subject: Rings, window: Rings) -> Rings:
    """Sutherland-Hodgman, row by row: the part of each subject inside its convex counter-clockwise window."""
    s = subject
    for k in range(window.x.shape[1]):
        used = k < window.n
        nxt = np.where(k + 1 < window.n, k + 1, 0)
        rows = np.arange(len(used))
        ax, ay, bx, by = window.x[:, k], window.y[:, k], window.x[rows, nxt], window.y[rows, nxt]
        d = (bx - ax)[:, None] * (s.y - ay[:, None]) - (by - ay)[:, None] * (s.x - ax[:, None])
        d = np.where(used[:, None], d, 0.0)  # a row without this edge keeps its ring
        qx, qy, dq = s.next(s.x), s.next(s.y), s.next(d)
        here = s.inside()
        with np.errstate(divide="ignore", invalid="ignore"):
            t = d / (d - dq)
            mx, my = s.x + (qx - s.x) * t, s.y + (qy - s.y) * t
        # behind each corner come the crossing of the edge, if any, and the next corner, if inside
        kept = np.stack([here & ((d >= 0) != (dq >= 0)), here & (dq >= 0)], 2).reshape(len(used), -1)
        place = np.cumsum(kept, 1) - 1
        n = kept.sum(1)
        row, col = np.nonzero(kept)
        shape = (len(used), int(n.max(initial=0)))
        x, y = np.zeros(shape), np.zeros(shape)
        x[row, place[row, col]] = np.stack([mx, qx], 2).reshape(len(used), -1)[row, col]
        y[row, place[row, col]] = np.stack([my, qy], 2).reshape(len(used), -1)[row, col]
        s = Rings(x, y, n)
    return s


def slab_area(rings: list[tuple[np.ndarray, np.ndarray]], inside) -> float:
    """The area where ``inside`` holds of the rings' winding numbers.

    The plane is cut at the heights of all corners and crossings; within a slab
    edges don't cross, so winding numbers change from edge to edge.  ``inside``
    takes an array ``(places, rings)`` of winding numbers.
    """
    x0, y0, x1, y1, of, sign = (np.concatenate(c) for c in zip(*map(_edges, range(len(rings)), rings), strict=True))
    if not len(x0):
        return 0.0
    slope = (x1 - x0) / (y1 - y0)
    lo, hi = np.maximum(y0[:, None], y0), np.minimum(y1[:, None], y1)
    at = lambda y: x0[:, None] + slope[:, None] * (y - y0[:, None])
    other = lambda y: x0 + slope * (y - y0)
    d0, d1 = at(lo) - other(lo), at(hi) - other(hi)
    cross = (lo < hi) & (d0 * d1 < 0)
    ys = lo[cross] + (hi[cross] - lo[cross]) * d0[cross] / (d0[cross] - d1[cross])
    levels = np.unique(np.concatenate([y0, y1, ys]))
    total = 0.0
    for a, b in zip(levels[:-1], levels[1:], strict=True):
        e = np.flatnonzero((y0 <= a) & (y1 >= b))
        mid = x0[e] + slope[e] * ((a + b) / 2 - y0[e])
        order = np.argsort(mid, kind="stable")
        e, mid = e[order], mid[order]
        wind = np.zeros((len(e), len(rings)), int)
        wind[np.arange(len(e)), of[e]] = sign[e]
        full = inside(np.cumsum(wind, 0)[:-1])
        total += (b - a) * (np.diff(mid) * full).sum()
    return float(total)


def _edges(k: int, ring: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Edges that aren't level, upwards, with their ring and direction."""
    x, y = ring
    x1, y1 = np.roll(x, -1), np.roll(y, -1)
    some = y != y1
    x, y, x1, y1 = x[some], y[some], x1[some], y1[some]
    up = y < y1
    return (
        np.where(up, x, x1), np.where(up, y, y1), np.where(up, x1, x), np.where(up, y1, y), np.full(len(x), k), np.where(up, 1, -1)
    )


def shared_area(a: Rings, b: Rings) -> np.ndarray:
    """Area of the intersection of each pair; the subject may be any simple ring, and so may the window."""
    b = b.counter_clockwise()
    easy = b.convex()
    out = np.zeros(len(a.n))
    rows = np.flatnonzero(easy & (b.n >= 3))
    out[rows] = np.abs(clipped(a[rows], b[rows]).signed_area())
    both = lambda w: (w != 0).all(1)
    for i in np.flatnonzero(~easy):
        pair = [(r.x[i, : r.n[i]], r.y[i, : r.n[i]]) for r in (a, b)]
        out[i] = slab_area(pair, both)
    return out


def _masked(values: np.ndarray, *inputs: pa.Array) -> pa.Array:
    null = np.zeros(len(values), bool)
    for c in inputs:
        null |= np.asarray(c.is_null())
    return pa.array(values, mask=null)


def _overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    return _masked(shared_area(Rings.of(a), Rings.of(b)), a, b)


def union_ratio(p: Rings, q: Rings) -> np.ndarray:
    """Intersection over union of each pair; 0 where the union is empty."""
    both, one, two = shared_area(p, q), np.abs(p.signed_area()), np.abs(q.signed_area())
    union = one + two - both
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(union > 0, both / union, 0.0)


def _ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return _masked(union_ratio(Rings.of(a), Rings.of(b)), a, b)


def _share(a: pa.Array, b: pa.Array, least: pa.Array) -> pa.Array:
    p = Rings.of(a)
    own, both = np.abs(p.signed_area()), shared_area(p, Rings.of(b))
    with np.errstate(divide="ignore", invalid="ignore"):
        return _masked(np.where(own <= np.asarray(least), 0.0, both / own), a, b)


_overlap_udf = F.arrow_udf(_overlap, DoubleType()).asNondeterministic()
_ratio_udf = F.arrow_udf(_ratio, DoubleType()).asNondeterministic()
_share_udf = F.arrow_udf(_share, DoubleType()).asNondeterministic()


def overlap_area(subject: Column, window: Column) -> Column:
    """Area that two simple rings share; null where one is null."""
    return _overlap_udf(subject.cast(RING), window.cast(RING))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two simple rings; 0 where the union is empty."""
    return _ratio_udf(a.cast(RING), b.cast(RING))


def visible_fraction(r: Column, window: Column, least_area: float = 1e-12) -> Column:
    """Share of a ring's area inside a window; 0 for a ring with hardly any area."""
    return _share_udf(r.cast(RING), window.cast(RING), F.lit(float(least_area)))
