import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import overlap, repair
from tests.test_geometry import RING, area_of, box, pts


POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def winding_area(ring):
    """Area of the places that a ring goes round in the direction of its whole area, by slabs."""
    total = area_of(ring)
    sign = -1 if total > 0 else 1  # slabs count rising edges as 1, from the left
    return overlap.slab_area([tuple(map(np.array, zip(*ring, strict=True)))], lambda w: sign * w[:, 0] >= 1)


def mended(ring):
    new = repair.loops(ring)
    return [ring] if new is None else new


def test_named_cases():
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    assert repair.loops(square) is None and repair.loops(square[::-1]) is None
    assert repair.loops([(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]) is None
    bow = mended([(0.0, 0.0), (6.0, 0.0), (0.0, 4.0), (2.0, 4.0)])
    assert len(bow) == 1 and len(bow[0]) == 3 and area_of(bow[0]) == pytest.approx(9.0)
    even = mended([(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)])
    assert len(even) == 1 and abs(area_of(even[0])) == pytest.approx(1.0)
    spike = mended([(0.0, 0.0), (4.0, 0.0), (9.0, -1.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])
    assert len(spike) == 1 and len(spike[0]) == 4 and area_of(spike[0]) == 16
    inner_spike = mended([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (1.0, 2.0), (4.0, 2.0), (4.0, 4.0), (0.0, 4.0)])
    assert len(inner_spike) == 1 and area_of(inner_spike[0]) == 16
    touching = mended([(0.0, 0.0), (0.0, 2.0), (1.0, 1.0), (2.0, 2.0), (2.0, 0.0), (1.0, 1.0)])
    assert sorted(round(abs(area_of(r)), 9) for r in touching) == [1, 1]
    keyhole = mended([(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0), (3.0, 3.0), (3.0, 6.0), (6.0, 6.0), (6.0, 3.0), (3.0, 3.0)])
    assert sorted(round(area_of(r), 9) for r in keyhole) == [-9, 81]
    twice = mended([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)] * 2)
    assert len(twice) == 1 and area_of(twice[0]) == 16
    assert mended([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]) == [] and mended([(0.0, 0.0), (1.0, 1.0)]) == [] and mended([]) == [] and mended([(1.0, 1.0)] * 5) == []


def test_random_rings_keep_what_they_wind_round():
    rng = random.Random(6)
    for k in range(300):
        n = rng.randrange(3, 12)
        grid = k % 2
        ring = [(float(rng.randrange(6)), float(rng.randrange(6))) if grid else (rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(n)]
        if abs(area_of(ring)) < 1e-9:
            continue
        new = mended(ring)
        if repair.loops(ring) is None:
            assert abs(area_of(ring)) == pytest.approx(winding_area(ring), abs=1e-9)
        else:
            assert sum(map(area_of, new)) == pytest.approx(winding_area(ring), abs=1e-7), ring
        for r in new:
            assert repair.loops(r) is None or len(new) == 1, ring  # loops are valid
        assert area_of(repair.joined(new)) == pytest.approx(sum(map(area_of, new)), abs=1e-7)


def test_columns(spark):
    rng = random.Random(3)
    bow = [(0, 0), (6, 0), (0, 4), (2, 4)]
    rows = [(0, pts(*bow)), (1, None), (2, []), (3, pts((0, 0), (1, 1))), (4, pts(*box(rng))), (5, pts((0, 0), (0, 2), (1, 1), (2, 2), (2, 0), (1, 1)))]
    df = spark.createDataFrame(rows, f"i int, ring {RING}")
    got = {r["i"]: (r["a"], r["f"]) for r in df.select("i", repair.repaired(F.col("ring")).alias("a"), repair.faces(F.col("ring")).alias("f")).collect()}
    plain = lambda r: [(p["x"], p["y"]) for p in r]
    assert area_of(plain(got[0][0])) == pytest.approx(9) and got[1] == (None, None) and got[2][0] == [] and got[3] == ([], [])
    assert plain(got[4][0]) == plain(rows[4][1]) and len(got[5][1]) == 2 and abs(area_of(plain(got[5][0]))) == pytest.approx(2)
    # what a mended ring shares with others is what its loops share
    window = F.lit(None).cast(RING)
    window = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
    r = df.where("i = 5").select(overlap.overlap_area(repair.repaired(F.col("ring")), window).alias("o"), overlap.overlap_area(window, repair.repaired(F.col("ring"))).alias("p")).first()
    assert r["o"] == pytest.approx(0.5) and r["p"] == pytest.approx(0.5)


def test_masks(spark):
    hole_bow = [(2, 2), (6, 2), (2, 4), (4, 4)]
    rows = [("a", "k", 0, 0, pts((0, 0), (9, 0), (9, 9), (0, 9), (0, 0), (3, 3), (3, 6), (6, 6), (6, 3), (3, 3))), ("b", "k", 0, 0, pts((0, 0), (9, 0), (9, 9), (0, 9))), ("b", "k", 0, 1, pts(*hole_bow)), ("c", "k", 0, 0, pts((0, 0), (1, 1), (2, 2)))]
    df = spark.createDataFrame(rows, f"image string, kind string, polygon_id int, ring_id int, ring {RING}")
    got = {}
    for r in repair.repair_masks(df).collect():
        a = abs(area_of([(p["x"], p["y"]) for p in r["ring"]]))
        got[r["image"]] = got.get(r["image"], 0) + (-a if r["ring_id"] else a)
    assert got == {"a": pytest.approx(72), "b": pytest.approx(81 - abs(winding_area([(float(x), float(y)) for x, y in hole_bow])))}
    assert math.isfinite(sum(got.values()))


def test_at_once_equals_one_by_one(monkeypatch):
    """Rings mended as matrices equal those mended one by one, and the frequent faults need no step of their own."""
    rng = random.Random(9)
    rings = []
    for k in range(600):
        n = rng.randrange(3, 9)
        ring = [(float(rng.randrange(6)), float(rng.randrange(6))) if k % 2 else (rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(n)]
        if k % 3 == 0:  # out and back
            i = rng.randrange(n)
            ring[i + 1 : i + 1] = [(rng.uniform(0, 10), rng.uniform(0, 10)), ring[i]]
        if abs(area_of(ring)) > 1e-6:
            rings.append(ring)
    got = list(repair._each(pa.array([pts(*r) for r in rings], POINTS)))
    for ring, new in zip(rings, got, strict=True):
        want = mended(ring)
        key = lambda loops: sorted((round(abs(area_of(r)), 7), len(r)) for r in loops)
        assert key(new) == key(want), ring
        if repair.loops(ring) is not None:
            assert sum(map(area_of, new)) == pytest.approx(sum(map(area_of, want)), abs=1e-7), ring

    def alone(ring):
        raise AssertionError(ring)

    monkeypatch.setattr(repair, "loops", alone)
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    frequent = [[(0.0, 0.0), (6.0, 0.0), (0.0, 4.0), (2.0, 4.0)], [*square[:2], (6.0, 0.0), *square[1:]], [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]]
    got = list(repair._each(pa.array([pts(*r) for r in frequent], POINTS)))
    assert [len(r[0]) for r in got] == [3, 4, 6] and [abs(area_of(r[0])) for r in got] == [pytest.approx(9), 16, 7]
