import importlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import detections, keyed, masks
from tessera.operators.dissolve import dissolve
from tests.test_geometry import RING, pts
from tests.test_operators import frame, iou_of, match_of, nms_of, scene


dissolve_module = importlib.import_module("tessera.operators.dissolve")
MASKS = f"image string, kind string, polygon_id int, ring_id int, ring {RING}"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("small", [0, 30, None])
def test_keys_of_any_size(spark, small):
    """Small keys come off one shuffle, larger ones go by cells; both choose alike, also side by side."""
    rows, truths = scene(21, 130), scene(22, 90, 2)
    kept = detections.suppress(frame(spark, rows), 0.1, small=small)
    assert sorted(r["ordinal"] for r in kept.collect()) == nms_of(rows, 0.1)
    m = detections.match(frame(spark, rows), frame(spark, truths), 0.1, small=small)
    assert {(r["p_ordinal"], r["t_ordinal"]) for r in m.collect()} == match_of(rows, truths, 0.1)
    same = lambda a, b: a[0] == b[0] and a[2] == b[2]
    got = {(r["a_ordinal"], r["b_ordinal"]): r["iou"] for r in detections.iou_pairs(frame(spark, rows), None, 0.0, small=small).collect()}
    want = {(a[1], b[1]): v for a in rows for b in rows if a[1] < b[1] and same(a, b) and (v := iou_of(a[4], b[4])) > 1e-12}
    assert {k for k, v in got.items() if v > 1e-12} == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())
    got = {(r["a_ordinal"], r["b_ordinal"]) for r in detections.iou_pairs(frame(spark, rows), frame(spark, truths), 0.1, small=small).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in truths if same(a, b) and iou_of(a[4], b[4]) > 0.1}


def test_one_shuffle(spark):
    """Boxes of small keys are moved once; no cells, no second shuffle of pairs."""
    rows = frame(spark, scene(23, 200))
    for df in (detections.suppress(rows, 0.2), detections.iou_pairs(rows, None, 0.0)):
        assert exchanges(df) == 1


def test_odd_rows(spark):
    """Rows without a key, ring or point stay, and equal rows don't fell each other."""
    sq = [(0, 0), (1, 0), (1, 1), (0, 1)]
    df = frame(spark, [("a", 0, 0, 0.5, sq), ("a", 1, 0, None, []), ("a", 2, 0, 0.4, sq), (None, 3, 0, 0.5, sq), (None, 4, 0, 0.5, sq), ("b", 5, None, 0.5, sq), ("b", 6, None, 0.4, sq)])
    df = df.unionByName(df.where("ordinal = 1").withColumns({"ordinal": F.lit(7).cast("long"), "ring": F.lit(None).cast(df.schema["ring"].dataType)}))
    for small in (0, None):
        assert sorted(r["ordinal"] for r in detections.suppress(df, 0.5, small=small).collect()) == [0, 1, 3, 4, 5, 6, 7]
        assert detections.match(df, df.where("image is null"), 0.5, small=small).count() == 0
    twice = df.where("ordinal = 0").unionByName(df.where("ordinal = 0"))
    assert detections.suppress(twice, 0.5).count() == 2 and detections.suppress(df.limit(0), 0.5).count() == 0


def test_slices_hold_whole_keys():
    keys = np.repeat(np.arange(40), np.random.default_rng(5).integers(1, 400, 40))
    t = pa.table({"k": keys})
    got = [(s.column("k").to_numpy(), g) for s, g in keyed.whole((b for b in t.to_batches(max_chunksize=97)), ["k"])]
    assert np.array_equal(np.concatenate([k for k, _ in got]), keys)
    owner = [set(k.tolist()) for k, _ in got]
    assert sum(map(len, owner)) == 40 and all(len(set(g.tolist())) == len(set(k.tolist())) for k, g in got)


def many_masks(seed, n):
    """Masks of one to four overlapping polygons, some of several kinds, for images ``i0 ..``; every third image has none."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        for p in range(rng.randrange(1, 5) if k % 3 else 0):
            x, y, w, h = (rng.randrange(-5, 12) for _ in range(4))
            rows.append((f"i{k}", rng.choice(["coastline", "other"]), p, int(rng.random() < 0.2), pts((x, y), (x + abs(w) + 1, y), (x + abs(w) + 1, y + abs(h) + 1.5), (x - 0.5, y + abs(h) + 1))))
    return rows


def test_covered_of_small_images(spark):
    """Images taken whole see what images that go by cells see, in one shuffle."""
    m = spark.createDataFrame(many_masks(31, 12), MASKS)
    b = frame(spark, [r for r in scene(32, 200, 12)] + [("i1", 900, 0, 0.5, [(0, 0)] * 4), ("i1", 901, 0, 0.5, []), (None, 902, 0, 0.5, [(0, 0), (1, 0), (1, 1)])])
    whole = masks.covered(b, m)
    assert exchanges(whole) == 1
    got, want = ({r["ordinal"]: (r["fraction"], r["has_mask"]) for r in df.collect()} for df in (whole, masks.covered(b, m, small=0)))
    assert len(want) == 203 and any(h for _, h in want.values()) and any(f and 0 < f < 1 for f, _ in want.values())
    for k, (fraction, known) in want.items():
        assert got[k][1] == known and (got[k][0] is None if fraction is None else got[k][0] == pytest.approx(fraction, abs=1e-12)), k


@pytest.mark.parametrize("cell", [None, 2.0, 0.7])
def test_small_masks_are_dissolved_alike(spark, cell):
    """Whole masks and those that Spark cuts up cell by cell become the same pieces."""
    m = spark.createDataFrame(many_masks(33, 12), MASKS)
    one, two = dissolve(m, cell), dissolve_module._dissolve_large(m.select("image", "kind", "ring_id", "ring"), cell)
    assert exchanges(one) == 1
    pieces = lambda df: sorted((r["image"], r["kind"], r["row"], r["col"], tuple((round(p["x"], 9), round(p["y"], 9)) for p in r["ring"])) for r in df.collect())
    assert pieces(one) == pieces(two) and pieces(one)


def test_sweep_at_once_equals_cell_by_cell():
    rng = np.random.default_rng(7)
    of = np.sort(rng.integers(0, 60, 500))
    p = {k: rng.integers(0, 5, 500) / 4.0 for k in ("xa", "ya", "xb", "yb")}
    cells = {"base": rng.integers(-1, 3, 60), "left": np.zeros(60), "low": np.zeros(60), "side": np.ones(60)}
    got_of, got = dissolve_module._swept_all(p, of, cells)
    for c in range(60):
        want = dissolve_module._swept(*(p[k][of == c] for k in ("xa", "ya", "xb", "yb")), int(cells["base"][c]), 0.0, 0.0, 1.0)
        assert sorted(map(tuple, got[got_of == c].round(12).tolist())) == sorted(tuple(np.round(t, 12).tolist()) for t in want), c
