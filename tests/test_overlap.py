import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import overlap
from tessera.operators import detections, greedy, masks
from tessera.operators.dissolve import dissolve
from tessera.operators.meeting import meeting
from tests.test_geometry import RING, area_of, box, clip_of, pts
from tests.test_operators import frame, match_of, nms_of, scene

MASKS = f"image string, kind string, polygon_id int, ring_id int, ring {RING}"
POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def arrow(*rings):
    return pa.array([None if r is None else pts(*r) for r in rings], POINTS)


def by_slabs(*rings):
    return overlap.slab_area([tuple(map(np.array, zip(*r, strict=True))) for r in rings], lambda w: (w != 0).all(1))


def test_kernel_equals_plain_python():
    rng = random.Random(1)
    pairs = [(box(rng), box(rng)) for _ in range(2000)]
    pairs = [(a, b if i % 2 else b[::-1]) for i, (a, b) in enumerate(pairs)]
    got = overlap._overlap(arrow(*[a for a, _ in pairs]), arrow(*[b for _, b in pairs])).to_pylist()
    for (a, b), v in zip(pairs, got, strict=True):
        assert v == pytest.approx(abs(area_of(clip_of(a, b if area_of(b) > 0 else b[::-1]))), abs=1e-9)
        assert v == pytest.approx(by_slabs(a, b), abs=1e-9)


def test_any_simple_rings():
    ell, square = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert overlap._overlap(arrow(square, ell, ell, None), arrow(ell, square, [(x + 0.5, y + 0.5) for x, y in ell], ell)).to_pylist() == [7, 7, pytest.approx(3.25), None]
    assert overlap._overlap(arrow([], square, square), arrow(square, [], [(0, 0), (1, 1)])).to_pylist() == [0, 0, 0]
    assert overlap._ratio(arrow([(0, 0)] * 4, square), arrow([(0, 0)] * 4, ell)).to_pylist() == [0, pytest.approx(7 / 16)]
    rng = random.Random(4)

    def star(n):
        return [(rng.uniform(1, 4) * math.cos(2 * math.pi * k / n) + 3, rng.uniform(1, 4) * math.sin(2 * math.pi * k / n)) for k in range(n)]

    pairs = [(star(rng.randrange(3, 15)), star(rng.randrange(3, 15))) for _ in range(60)]
    got = overlap._overlap(arrow(*[a for a, _ in pairs]), arrow(*[b for _, b in pairs])).to_pylist()
    assert got == [pytest.approx(by_slabs(a, b), abs=1e-9) for a, b in pairs]


@pytest.mark.parametrize("cell", [None, 3.0])
def test_meeting_at_any_scale(spark, cell):
    """Every pair of bounds that touch, once, whatever their sizes."""
    rng = random.Random(8)
    sides = [0.0, 1e-6, 0.5, 3, 40] if cell is None else [0.0, 0.5, 3, 10]

    def some(n):
        out = []
        for k in range(n):
            x, y, w, h = rng.choice([rng.uniform(-20, 20), rng.randrange(-8, 8)]), rng.uniform(-20, 20), rng.choice(sides), rng.choice(sides)
            out.append((rng.choice("ab"), k, (float(x), float(y), float(x + w), float(y + h))))
        return out

    a, b = some(120), some(90)
    schema = "image string, {0} int, {0}_b struct<x0:double,y0:double,x1:double,y1:double>"
    got = meeting(spark.createDataFrame(a, schema.format("a")), spark.createDataFrame(b, schema.format("b")), ["image"], "a_b", "b_b", cell).collect()
    want = {(p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and max(p[2][0], q[2][0]) <= min(p[2][2], q[2][2]) and max(p[2][1], q[2][1]) <= min(p[2][3], q[2][3])}
    assert len(got) == len(want) and {(r["image"], r["a"], r["b"]) for r in got} == want


@pytest.mark.parametrize("block_rows", [4, 25])
def test_rounds_equal_one_pass(spark, block_rows):
    rows, truths = scene(11, 160, 1), scene(12, 90, 1)
    kept = detections.suppress(frame(spark, rows), 0.1, block_rows=block_rows)
    assert sorted(r["ordinal"] for r in kept.collect()) == nms_of(rows, 0.1)
    m = detections.match(frame(spark, rows), frame(spark, truths), 0.1, block_rows=block_rows)
    assert {(r["p_ordinal"], r["t_ordinal"]) for r in m.collect()} == match_of(rows, truths, 0.1)


def test_long_chain(spark):
    """5,000 boxes in a row, each felling the next if it stays: every second one stays, in one pass and in a few rounds."""
    sq = lambda x: [(x, 0), (x + 10, 0), (x + 10, 10), (x, 10)]
    rows = frame(spark, [("a", k, 0, 1 - k / 5000, sq(5 * k)) for k in range(5000)])
    want = list(range(0, 5000, 2))
    for block_rows in (None, 1000):
        assert sorted(r["ordinal"] for r in detections.suppress(rows, 0.3, block_rows=block_rows).collect()) == want


def test_blocks_are_bounded(spark):
    rows = spark.range(5000).selectExpr("'a' AS image", "id", "rand(3) AS place").unionByName(spark.range(10).selectExpr("'b' AS image", "id", "1.0 AS place"))
    blocks, several = greedy.with_blocks(rows, ["image"], "place", 500)
    sizes = {(r["image"], r["__block"]): r["count"] for r in blocks.groupBy("image", "__block").count().collect()}
    assert several and max(sizes.values()) <= 600 and sum(sizes.values()) == 5010 and sizes["b", 0] == 10
    assert not greedy.with_blocks(rows, ["image"], "place", 5000)[1]


def sum_of(df):
    rows = df.groupBy("image").agg(F.collect_list("ring").alias("g")).collect()
    return {r["image"]: sum(abs(area_of([(p["x"], p["y"]) for p in g])) for g in r["g"]) for r in rows}


@pytest.mark.parametrize("cell", [None, 1.0, 2.0, 0.7, 50.0])
def test_dissolve(spark, cell):
    rng = random.Random(2)
    rows, want = [], {}
    directed = lambda r, hole: r if (area_of(r) > 0) != hole else r[::-1]
    for m in range(16):
        rings = []
        for p in range(rng.randrange(1, 5)):
            if m % 2:  # corners and sides on the grid's lines, with holes and shared sides
                x, y, w, h = (rng.randrange(8) for _ in range(4))
                outline = [(x, y), (x + w + 1, y), (x + w + 1, y + h + 1), (x, y + h + 1)]
                if w > 1 and h > 1:
                    hole = [(x + 1, y + 1), (x + w, y + 1), (x + w, y + h), (x + 1, y + h)]
                    rings.append(directed(hole, True))
                    rows.append((f"m{m}", "k", p, 1, pts(*hole)))
            else:
                n, cx, cy = rng.randrange(3, 50), rng.uniform(0, 10), rng.uniform(0, 10)
                outline = [(cx + rng.uniform(2, 7) * math.cos(2 * math.pi * k / n), cy + rng.uniform(2, 7) * math.sin(2 * math.pi * k / n)) for k in range(n)]
            rings.append(directed(outline, False))
            rows.append((f"m{m}", "k", p, 0, pts(*(outline if p % 2 else outline[::-1]))))
        want[f"m{m}"] = overlap.slab_area([tuple(map(np.array, zip(*r, strict=True))) for r in rings], lambda w: w.sum(1) < 0)
    got = sum_of(dissolve(spark.createDataFrame(rows, MASKS), cell))
    assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}


def test_large_mask_is_cut_up(spark):
    """A coast of 20,000 edges: no cell has more than a small part of it, and boxes see what they should."""
    n = 20000
    coast = [(1000 * math.cos(2 * math.pi * k / n), 1000 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    m = spark.createDataFrame([("a", "coastline", 0, 0, pts(*coast)), ("b", "coastline", 0, 0, pts((0, 0), (1, 0), (1, 1)))], MASKS)
    pieces = dissolve(m).cache()
    assert sum_of(pieces)["a"] == pytest.approx(abs(area_of(coast)))
    assert pieces.groupBy("row", "col").count().agg(F.max("count")).first()[0] < n / 10
    sq = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    b = frame(spark, [("a", 0, 0, 0.5, sq(-5, -5, 10)), ("a", 1, 0, 0.5, sq(990, -5, 20)), ("a", 2, 0, 0.5, sq(900, 900, 5)), ("a", 3, 0, 0.5, sq(-2000, -2000, 4000)), ("c", 4, 0, 0.5, sq(0, 0, 1))])
    got = {r["ordinal"]: (r["fraction"], r["has_mask"]) for r in masks.covered(b, m).collect()}
    clipped = by_slabs(coast, sq(990, -5, 20)) / 400
    assert got == {0: (pytest.approx(1), True), 1: (pytest.approx(clipped), True), 2: (0, True), 3: (pytest.approx(abs(area_of(coast)) / 16e6), True), 4: (0, False)}
