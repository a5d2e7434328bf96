"""Planar geometry as Spark column expressions.

A ring is ``array<struct<x double, y double>>``, not closed.  Everything here
stays in Catalyst: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(*xy: tuple[Column, Column]) -> Column:
    return F.array(*[point(x, y) for x, y in xy])


def _next(r: Column, i: Column) -> Column:
    return F.element_at(r, (i % F.size(r) + 1).cast("int"))


def _positions(r: Column) -> Column:
    return F.sequence(F.lit(1), F.size(r))


def signed_area(r: Column) -> Column:
    """Shoelace area, positive for counter-clockwise rings; 0 for fewer than three points."""

    def summed(v: Column) -> Column:
        def term(acc: Column, i: Column) -> Column:
            return let(
                F.struct(F.element_at(v, i).alias("p"), _next(v, i).alias("q")),
                lambda e: acc + (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]),
            )

        return F.when(F.size(v) < 3, F.lit(0.0)).otherwise(F.aggregate(_positions(v), F.lit(0.0), term) / 2.0)

    return let(r, summed)


def area(r: Column) -> Column:
    return F.abs(signed_area(r))


def counter_clockwise(r: Column) -> Column:
    return let(r, lambda a: F.when(signed_area(a) < 0, F.reverse(a)).otherwise(a))


def centroid(r: Column) -> Column:
    """Area centroid; the mean of the points where the area is 0."""

    def around(v: Column) -> Column:
        def term(acc: Column, i: Column) -> Column:
            def add(e: Column) -> Column:
                p, q, c = e["p"], e["q"], e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
                return F.struct(
                    (acc["a"] + c).alias("a"), (acc["x"] + (p["x"] + q["x"]) * c).alias("x"), (acc["y"] + (p["y"] + q["y"]) * c).alias("y")
                )

            return let(F.struct(F.element_at(v, i).alias("p"), _next(v, i).alias("q")), add)

        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        mean = lambda k: F.aggregate(v, F.lit(0.0), lambda s, p: s + p[k]) / F.size(v)
        middle = lambda t: F.when(t["a"] != 0, point(t["x"] / (3.0 * t["a"]), t["y"] / (3.0 * t["a"]))).otherwise(point(mean("x"), mean("y")))
        return F.when(F.size(v) > 0, let(F.aggregate(_positions(v), zero, term), middle))

    return let(r, around)


def bounds(r: Column) -> Column:
    axis = lambda k: F.transform(r, lambda p: p[k])
    both = F.struct(axis("x").alias("x"), axis("y").alias("y"))
    return let(
        both,
        lambda v: F.struct(
            F.array_min(v["x"]).alias("x0"), F.array_min(v["y"]).alias("y0"), F.array_max(v["x"]).alias("x1"), F.array_max(v["y"]).alias("y1")
        ),
    )


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def _side(a: Column, b: Column, p: Column) -> Column:
    """Positive where ``p`` is left of the line from a to b."""
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def _cut_by_edge(r: Column, a: Column, b: Column) -> Column:
    def piece(i: Column) -> Column:
        ends = F.struct(F.element_at(r, i).alias("p"), _next(r, i).alias("q"))
        sides = let(ends, lambda e: F.struct(e["p"].alias("p"), e["q"].alias("q"), _side(a, b, e["p"]).alias("dp"), _side(a, b, e["q"]).alias("dq")))

        def kept(e: Column) -> Column:
            t = e["dp"] / (e["dp"] - e["dq"])
            meet = point(e["p"]["x"] + (e["q"]["x"] - e["p"]["x"]) * t, e["p"]["y"] + (e["q"]["y"] - e["p"]["y"]) * t)
            return (
                F.when((e["dp"] >= 0) & (e["dq"] >= 0), F.array(e["q"]))
                .when(e["dp"] >= 0, F.array(meet))
                .when(e["dq"] >= 0, F.array(meet, e["q"]))
                .otherwise(F.array().cast(RING))
            )

        return let(sides, kept)

    return F.when(F.size(r) == 0, r).otherwise(F.flatten(F.transform(_positions(r), piece)))


def clip(subject: Column, window: Column) -> Column:
    """Sutherland-Hodgman: the part of ``subject`` inside the convex, counter-clockwise ``window``.

    The area of the result is exact for any simple subject.
    """
    edges = F.transform(_positions(window), lambda i: F.struct(F.element_at(window, i).alias("a"), _next(window, i).alias("b")))
    return F.aggregate(edges, subject.cast(RING), lambda r, e: _cut_by_edge(r, e["a"], e["b"]))


def overlap_area(subject: Column, window: Column) -> Column:
    return let(counter_clockwise(window), lambda w: area(clip(subject, w)))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two convex rings; 0 where the union is empty."""

    def ratio(v: Column) -> Column:
        union = v["a"] + v["b"] - v["both"]
        return F.when(union > 0, v["both"] / union).otherwise(F.lit(0.0))

    apart = let(F.struct(bounds(a).alias("a"), bounds(b).alias("b")), lambda v: ~boxes_meet(v["a"], v["b"]))
    values = F.struct(area(a).alias("a"), area(b).alias("b"), overlap_area(a, b).alias("both"))
    return F.when(apart, F.lit(0.0)).otherwise(let(values, ratio))


def visible_fraction(r: Column, window: Column, least_area: float = 1e-12) -> Column:
    """Share of a ring's area inside a convex window; 0 for a ring with hardly any area."""
    return let(
        F.struct(area(r).alias("all"), overlap_area(r, window).alias("both")),
        lambda v: F.when(v["all"] <= least_area, F.lit(0.0)).otherwise(v["both"] / v["all"]),
    )


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def oriented_box(cx: Column, cy: Column, w: Column, h: Column, cos: Column, sin: Column) -> Column:
    """Corners of a turned box, in order around it."""
    corner = lambda sx, sy: (cx + (sx * w * cos - sy * h * sin), cy + (sx * w * sin + sy * h * cos))
    return ring(corner(-0.5, -0.5), corner(0.5, -0.5), corner(0.5, 0.5), corner(-0.5, 0.5))


# ----------------------------------------------------------- affine transforms


def to_world(r: Column, t: Column) -> Column:
    """Pixels to map coordinates by an affine struct a..f."""
    return F.transform(r, lambda p: point(t["a"] * p["x"] + t["b"] * p["y"] + t["c"], t["d"] * p["x"] + t["e"] * p["y"] + t["f"]))


def to_pixels(r: Column, t: Column) -> Column:
    """Map coordinates to pixels by the inverse of an affine struct; null where there is none."""
    det = t["a"] * t["e"] - t["b"] * t["d"]

    def inverse(p: Column) -> Column:
        dx, dy = p["x"] - t["c"], p["y"] - t["f"]
        return point((t["e"] * dx - t["b"] * dy) / det, (t["a"] * dy - t["d"] * dx) / det)

    return F.when(det != 0, F.transform(r, inverse))


def scaled_affine(t: Column, sx: Column, sy: Column) -> Column:
    """The same extent with pixels smaller by the scales."""
    return F.struct(
        (t["a"] / sx).alias("a"), (t["b"] / sy).alias("b"), t["c"].alias("c"),
        (t["d"] / sx).alias("d"), (t["e"] / sy).alias("e"), t["f"].alias("f"),
    )


def shifted_affine(t: Column, x: Column, y: Column) -> Column:
    """The transform of a window whose corner is at pixel (x, y)."""
    return F.struct(
        t["a"].alias("a"), t["b"].alias("b"), (t["c"] + t["a"] * x + t["b"] * y).alias("c"),
        t["d"].alias("d"), t["e"].alias("e"), (t["f"] + t["d"] * x + t["e"] * y).alias("f"),
    )


# ---------------------------------------------------------------- annotations


def least_sides(r: Column, least: float) -> Column:
    """Rebuild a box as a parallelogram around its centre with sides of at least ``least``.

    Axes run from the first corner to the second and to the fourth; an axis of
    no length is that of the image.
    """
    half = least / 2.0

    def axis(p: Column, q: Column, default: tuple[float, float]) -> Column:
        d = F.struct((q["x"] - p["x"]).alias("x"), (q["y"] - p["y"]).alias("y"))
        return let(
            d,
            lambda v: let(
                F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]),
                lambda n: F.when(n > 1e-9, F.struct((v["x"] / n * F.greatest(n / 2.0, F.lit(half))).alias("x"), (v["y"] / n * F.greatest(n / 2.0, F.lit(half))).alias("y")))
                .otherwise(F.struct(F.lit(default[0] * half).alias("x"), F.lit(default[1] * half).alias("y"))),
            ),
        )

    p = [r[i] for i in range(4)]
    centre = point((p[0]["x"] + p[1]["x"] + p[2]["x"] + p[3]["x"]) / 4.0, (p[0]["y"] + p[1]["y"] + p[2]["y"] + p[3]["y"]) / 4.0)
    parts = F.struct(centre.alias("c"), axis(p[0], p[1], (1.0, 0.0)).alias("a"), axis(p[0], p[3], (0.0, 1.0)).alias("b"))
    at = lambda v, s, t: (v["c"]["x"] + s * v["a"]["x"] + t * v["b"]["x"], v["c"]["y"] + s * v["a"]["y"] + t * v["b"]["y"])
    return let(parts, lambda v: ring(at(v, -1, -1), at(v, 1, -1), at(v, 1, 1), at(v, -1, 1)))


def normalised(r: Column, w: Column, h: Column) -> Column:
    """Pixels as shares of the image, each clamped to 0..1."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.transform(r, lambda p: point(unit(p["x"] / w), unit(p["y"] / h)))


def convex_hull(r: Column) -> Column:
    """Convex hull by monotone chains, counter-clockwise from the least point."""

    def chain(points: Column) -> Column:
        def add(hull: Column, p: Column) -> Column:
            # drop from the end while the last turn isn't to the left
            drop = F.aggregate(
                F.sequence(F.lit(1), F.greatest(F.size(hull), F.lit(1))),
                hull,
                lambda h, _: F.when(
                    (F.size(h) >= 2) & (_side(F.element_at(h, -2), F.element_at(h, -1), p) <= 0), F.slice(h, F.lit(1), F.size(h) - 1)
                ).otherwise(h),
            )
            return F.concat(drop, F.array(p))

        return F.aggregate(points, F.array().cast(RING), add)

    def both(s: Column) -> Column:
        halves = F.struct(chain(s).alias("lo"), chain(F.reverse(s)).alias("hi"))
        ends = lambda h: F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0)))
        return F.when(F.size(s) < 3, s).otherwise(let(halves, lambda v: F.concat(ends(v["lo"]), ends(v["hi"]))))

    return let(F.array_sort(F.array_distinct(r.cast(RING))), both)


def least_rectangle(r: Column) -> Column:
    """The rotated rectangle of least area around a ring; null for fewer than three distinct corners."""

    def around(hull: Column) -> Column:
        def candidate(i: Column) -> Column:
            p, q = F.element_at(hull, i), _next(hull, i)
            d = F.struct((q["x"] - p["x"]).alias("x"), (q["y"] - p["y"]).alias("y"))

            def turned(u: Column) -> Column:
                along = F.transform(hull, lambda v: v["x"] * u["x"] + v["y"] * u["y"])
                across = F.transform(hull, lambda v: v["y"] * u["x"] - v["x"] * u["y"])
                e = F.struct(F.array_min(along).alias("s0"), F.array_max(along).alias("s1"), F.array_min(across).alias("t0"), F.array_max(across).alias("t1"))
                xy = lambda s, t: (s * u["x"] - t * u["y"], s * u["y"] + t * u["x"])
                return let(
                    e,
                    lambda b: F.struct(
                        ((b["s1"] - b["s0"]) * (b["t1"] - b["t0"])).alias("area"),
                        ring(xy(b["s0"], b["t0"]), xy(b["s1"], b["t0"]), xy(b["s1"], b["t1"]), xy(b["s0"], b["t1"])).alias("ring"),
                    ),
                )

            n = lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
            return let(d, lambda v: let(F.struct((v["x"] / n(v)).alias("x"), (v["y"] / n(v)).alias("y")), turned))

        return F.when(F.size(hull) >= 3, F.array_min(F.transform(_positions(hull), candidate))["ring"])

    return let(convex_hull(r), around)
