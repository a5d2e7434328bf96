import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import crs
from tessera.functions import geometry as g

RING = "array<struct<x:double,y:double>>"


def pts(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def plain(ring):
    return [(p["x"], p["y"]) for p in ring]


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {RING if isinstance(cols[n], list) else 'double'}" for n in names))
    return df.select(expr.alias("v")).first()["v"]


def area_of(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2


def clip_of(subject, window):
    out = subject
    for (ax, ay), (bx, by) in zip(window, window[1:] + window[:1]):
        new = []
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        for p, q in zip(out, out[1:] + out[:1]):
            dp, dq = side(p), side(q)
            if (dp >= 0) != (dq >= 0):
                t = dp / (dp - dq)
                new.append((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
            if dq >= 0:
                new.append(q)
        out = new
    return out


def box(rng):
    cx, cy, w, h, a = rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0.5, 6), rng.uniform(0.5, 6), rng.uniform(0, math.pi)
    c, s = math.cos(a), math.sin(a)
    return [(cx + (u * w * c - v * h * s) / 2, cy + (u * w * s + v * h * c) / 2) for u, v in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def test_random_boxes_against_plain_python(spark):
    rng = random.Random(1)
    pairs = [(box(rng), box(rng)) for _ in range(300)]
    df = spark.createDataFrame([(i, pts(*a), pts(*(b if i % 2 else b[::-1]))) for i, (a, b) in enumerate(pairs)], f"i int, a {RING}, b {RING}")
    for r in df.select("i", g.overlap_area(F.col("a"), F.col("b")).alias("o"), g.iou(F.col("a"), F.col("b")).alias("u")).collect():
        a, b = pairs[r["i"]]
        both = abs(area_of(clip_of(a, b)))
        assert r["o"] == pytest.approx(both, abs=1e-9)
        assert r["u"] == pytest.approx(both / (area_of(a) + area_of(b) - both), abs=1e-9)


def test_degenerate_rings(spark):
    for ring in ([], pts((1, 1)), pts((1, 1), (2, 2)), pts((3, 3), (3, 3), (3, 3), (3, 3))):
        assert one(spark, g.area(F.col("r")), r=ring) == 0
        assert one(spark, g.iou(F.col("r"), F.col("r")), r=ring or pts((0, 0))) == 0
    assert one(spark, g.centroid(F.col("r")), r=pts((1, 1), (3, 1)))["x"] == 2


def test_centroid_and_affine(spark):
    r = pts((0, 0), (4, 0), (4, 2), (0, 2))
    c = one(spark, g.centroid(F.col("r")), r=r)
    assert (c["x"], c["y"]) == (2, 1)
    t = F.struct(*[F.lit(v).alias(k) for k, v in zip("abcdef", (2.0, 0.5, 10.0, -0.25, -2.0, 20.0))])
    back = one(spark, g.to_pixels(g.to_world(F.col("r"), t), t), r=r)
    assert [v for p in plain(back) for v in p] == pytest.approx([0, 0, 4, 0, 4, 2, 0, 2])
    flat = F.struct(*[F.lit(1.0).alias(k) for k in "abcdef"])
    assert one(spark, g.to_pixels(F.col("r"), flat), r=r) is None


def test_least_sides_of_a_point(spark):
    got = one(spark, g.least_sides(F.col("r"), 2.0), r=pts((5, 5), (5, 5), (5, 5), (5, 5)))
    assert plain(got) == [(4, 4), (6, 4), (6, 6), (4, 6)]


def test_normalised_clamps(spark):
    got = one(spark, g.normalised(F.col("r"), F.lit(100.0), F.lit(100.0)), r=pts((-1, 50), (120, 100)))
    assert plain(got) == [(0, 0.5), (1, 1)]


def test_least_rectangle(spark):
    rng = random.Random(4)
    for _ in range(20):
        b = box(rng)
        inner = [(sum(w * p[0] for w, p in zip(ws, b)), sum(w * p[1] for w, p in zip(ws, b))) for ws in ([0.25] * 4, [0.7, 0.1, 0.1, 0.1])]
        got = plain(one(spark, g.least_rectangle(F.col("r")), r=pts(*rng.sample(b + inner, 6))))
        assert abs(area_of(got)) == pytest.approx(area_of(b), rel=1e-9)
        assert all(min(math.dist(p, q) for q in got) < 1e-6 for p in b)
    assert one(spark, g.least_rectangle(F.col("r")), r=pts((0, 0), (1, 1))) is None
    assert one(spark, g.least_rectangle(F.col("r")), r=pts((0, 0), (1, 1), (2, 2))) is None


@pytest.mark.parametrize(
    "lon, lat, system, east, north",
    [(45.0, 0.0, "EPSG:32638", 500000.0, 0.0), (2.2945, 48.8584, "EPSG:32631", 448251.898, 5411943.794), (-51.21, -30.03, "EPSG:32722", 479752.8, 6677814.5)],
)
def test_utm(spark, lon, lat, system, east, north):
    p = F.struct(F.col("x"), F.col("y"))
    got = one(spark, crs.to_utm(p, system), x=lon, y=lat)
    assert got["x"] == pytest.approx(east, abs=60) and got["y"] == pytest.approx(north, abs=60)
    back = one(spark, crs.from_utm(F.struct(F.lit(got["x"]).alias("x"), F.lit(got["y"]).alias("y")), system), x=0.0)
    assert back["x"] == pytest.approx(lon, abs=1e-10) and back["y"] == pytest.approx(lat, abs=1e-10)


def test_utm_scale_and_round_trip(spark):
    """On the central meridian northing is 0.9996 of the meridian arc; everywhere a round trip returns."""
    arc = one(spark, crs.to_utm(F.struct(F.col("x"), F.col("y")), "EPSG:32739"), x=51.0, y=-15.0)
    assert arc["x"] == pytest.approx(500000, abs=1e-6) and arc["y"] == pytest.approx(10000000 - 0.9996 * 1658989.589, abs=2)
    ring = pts((48.2, -18.9), (53.9, -12.1), (51.0, 0.0))
    back = one(spark, crs.reproject(crs.reproject(F.col("r"), "EPSG:4326", "EPSG:32739"), "EPSG:32739", "WGS84"), r=ring)
    for p, q in zip(plain(back), plain(ring)):
        assert p == pytest.approx(q, abs=1e-10)


def test_unknown_crs():
    with pytest.raises(ValueError):
        crs.utm_zone("EPSG:2154")
    assert crs.is_wgs84(" epsg:4326")
