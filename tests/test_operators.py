import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import annotate, detections, grid, masks, metrics, raster, split, tiling
from tessera.plans.pipeline import Config, Registry, evaluate, postprocessing, predict
from tessera.sources import geojson, labels, rasters
from tests.test_geometry import area_of, box, clip_of, pts

RING = "array<struct<x:double,y:double>>"
SCHEMA = f"image string, ordinal long, class_id int, confidence double, ring {RING}"


def iou_of(a, b):
    both = abs(area_of(clip_of(a, b)))
    union = abs(area_of(a)) + abs(area_of(b)) - both
    return both / union if union > 0 else 0.0


def scene(seed, n, images=3):
    rng = random.Random(seed)
    return [(f"i{rng.randrange(images)}", k, rng.randrange(2), rng.choice([None, round(rng.random(), 1)]), box(rng)) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r[:4], pts(*r[4])) for r in rows], SCHEMA)


def nms_of(rows, t):
    kept = []
    for r in sorted(rows, key=lambda r: -(r[3] or 0)):
        if not any(k[0] == r[0] and k[2] == r[2] and iou_of(k[4], r[4]) >= t for k in kept):
            kept.append(r)
    return sorted(r[1] for r in kept)


@pytest.mark.parametrize("t", [-0.5, 0.0, 0.05, 0.2, 0.5, 1.0])
def test_suppress(spark, t):
    rows = scene(1, 120)
    assert sorted(r["ordinal"] for r in detections.suppress(frame(spark, rows), t).collect()) == nms_of(rows, t)


def test_suppress_chain_and_classes(spark):
    sq = lambda x: [(x, 0), (x + 10, 0), (x + 10, 10), (x, 10)]
    rows = [("a", 0, 0, 0.9, sq(0)), ("a", 1, 0, 0.8, sq(5)), ("a", 2, 0, 0.7, sq(10)), ("a", 3, 1, 0.1, sq(0)), ("a", 4, 0, 0.9, sq(0))]
    assert sorted(r["ordinal"] for r in detections.suppress(frame(spark, rows), 0.3).collect()) == [0, 2, 3]


def match_of(preds, truths, t):
    out, used = set(), set()
    for p in sorted(preds, key=lambda r: -(r[3] or 0)):
        best, at = t, None
        for k, g in enumerate(truths):
            if g[0] == p[0] and g[2] == p[2] and k not in used and (v := iou_of(p[4], g[4])) >= best:
                best, at = v, k
        if at is not None:
            used.add(at)
            out.add((p[1], truths[at][1]))
    return out


@pytest.mark.parametrize("t", [0.0, 0.1, 0.4])
def test_match(spark, t):
    preds, truths = scene(2, 90), scene(3, 60)
    m = detections.match(frame(spark, preds), frame(spark, truths), t)
    assert {(r["p_ordinal"], r["t_ordinal"]) for r in m.collect()} == match_of(preds, truths, t)


def test_overlapping_masks_count_once(spark):
    sq = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    b = frame(spark, [("a", 0, 0, 0.9, sq(0, 0, 10, 10)), ("a", 1, 0, 0.8, sq(20, 0, 30, 10)), ("b", 0, 0, 0.8, sq(0, 0, 1, 1))])
    ring = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    rows = [("a", "coastline", 0, 0, ring(sq(0, 0, 3, 10))), ("a", "coastline", 1, 0, ring(sq(0, 0, 3, 10))), ("a", "coastline", 2, 0, ring(sq(2, 5, 5, 50)))]
    rows += [("a", "coastline", 2, 1, ring(sq(4, 6, 4.5, 8))), ("a", "coastline", 3, 0, ring(sq(18, -5, 24, 50)))]
    m = spark.createDataFrame(rows, "image string, kind string, polygon_id int, ring_id int, ring array<struct<x:double,y:double>>")
    got = {(r["image"], r["ordinal"]): r["fraction"] for r in masks.covered(b, m).collect()}
    assert got[("a", 0)] == pytest.approx((30 + 10 - 1) / 100) and got[("a", 1)] == pytest.approx(0.4) and got[("b", 0)] == 0


def test_evaluation_only_of_images_with_predictions(spark):
    sq = [(0, 0), (1, 0), (1, 1), (0, 1)]
    p = frame(spark, [("a", 0, 0, 0.5, sq)])
    t = frame(spark, [("a", 0, 0, None, sq), ("b", 0, 0, None, sq), ("c", 0, 0, None, sq)])
    files = spark.createDataFrame([("a",), ("b",)], "image string")
    count = lambda **how: {r["Class"]: (r["TP"], r["FP"], r["FN"]) for r in evaluate(p, t, None, 0.5, **how)[0].collect()}["ALL_CLASSES"]
    assert count() == (1, 0, 2) and count(predicted=files) == (1, 0, 1)


def test_match_tie_takes_the_later_truth(spark):
    sq = [(0, 0), (1, 0), (1, 1), (0, 1)]
    m = detections.match(frame(spark, [("a", 0, 0, 0.5, sq)]), frame(spark, [("a", 7, 0, None, sq), ("a", 8, 0, None, sq)]), 0.5)
    assert [(r["p_ordinal"], r["t_ordinal"]) for r in m.collect()] == [(0, 8)]


def test_evaluation_and_deleted(spark):
    sq = lambda x: [(x, 0), (x + 4, 0), (x + 4, 4), (x, 4)]
    raw = frame(spark, [("a", 0, 0, 0.9, sq(0)), ("a", 1, 0, 0.8, sq(100)), ("a", 2, 1, 0.7, sq(50)), ("b", 0, 0, 0.9, sq(0))])
    truth = frame(spark, [("a", 0, 0, None, sq(1)), ("a", 1, 5, None, sq(9))])
    table, rows = evaluate(raw.where("not (image = 'a' and ordinal = 1)"), truth, raw, 0.2, {0: "small"})
    got = {r["Class"]: (r["TP"], r["FP"], r["FN"]) for r in table.collect()}
    assert got == {"small": (1, 0, 0), "1": (0, 1, 0), "5": (0, 0, 1), "ALL_CLASSES": (1, 1, 1)}
    assert [r["Class"] for r in table.collect()] == ["small", "1", "5", "ALL_CLASSES"]
    seen = sorted((r["branch"], r["label"], r["class_id"], r["confidence"], r["ground_truth"], r["deleted"]) for r in rows.collect())
    assert seen == [(0, "FP", 1, 0.7, None, False), (0, "TP", 0, 0.9, 0, False), (1, "FN", 5, None, 5, False), (2, "FP", 0, 0.8, None, True)]
    text = geojson.collections(rows.withColumn("class_name", F.lit("c")), evaluation=True).first()["value"]
    assert '"metadata":{"total_features":4,"TP":1,"FP":1,"FN":1,"deleted":1}' in text


#: Published counts and ratios: TP, FP, FN, precision, recall, F1, bias.
PUBLISHED = [(81, 62, 54, 0.5664, 0.6, 0.5827, 5.93), (0, 0, 34, 0, 0, 0, -100.0), (0, 1, 2, 0, 0, 0, -50.0), (116, 80, 125, 0.5918, 0.4813, 0.5309, -18.67), (123, 101, 118, 0.5491, 0.5104, 0.529, -7.05)]


def test_ratios(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(PUBLISHED)], "class_id int, TP long, FP long, FN long")
    for r in metrics.with_ratios(df, digits=True).collect():
        want = PUBLISHED[r["class_id"]]
        assert (r["Precision"], r["Recall"], r["F1"]) == pytest.approx(want[3:6], abs=1e-4) and r["Bias (%)"] == pytest.approx(want[6], abs=1e-2)


def test_sweep(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["TP", "FP", "FN", "x"]), rng.choice([None, 0.29, 0.3, rng.random() / 2])) for _ in range(300)]
    got = metrics.threshold_sweep(spark.createDataFrame(rows, "label string, confidence double")).collect()
    assert len(got) == 50
    for r in got:
        t = 0.01 + r["i"] * 0.01
        known = [(k, c) for k, c in rows if c is not None]
        tp, fp = sum(k == "TP" and c >= t for k, c in known), sum(k == "FP" and c >= t for k, c in known)
        fn = sum(k == "FN" for k, _ in rows) + sum(k == "TP" and c < t for k, c in known)
        assert (r["TP"], r["FP"], r["FN"], r["threshold"]) == (tp, fp, fn, t)
    empty = metrics.threshold_sweep(spark.createDataFrame([], "label string, confidence double"))
    assert empty.agg(F.sum(F.col("TP") + F.col("FP") + F.col("FN"))).first()[0] == 0
    assert metrics.sweep_display(empty).first()["% TP"] == "0.0%"


def test_masks(spark):
    sq = lambda x, s=10: [(x, 0), (x + s, 0), (x + s, s), (x, s)]
    boxes = frame(spark, [("a", 0, 0, 0.5, sq(0)), ("a", 1, 0, 0.5, sq(5)), ("a", 2, 0, 0.5, sq(50)), ("b", 3, 0, 0.5, sq(50)), ("a", 4, 0, 0.5, [(90, 0)] * 4)])
    schema = f"image string, kind string, polygon_id int, ring_id int, ring {RING}"
    m = spark.createDataFrame([("a", "coastline", 0, 0, pts(*sq(0))), ("a", "buildings", 0, 0, pts(*sq(0, 20))), ("a", "buildings", 0, 1, pts(*sq(0)))], schema)
    ids = lambda df: sorted(r["ordinal"] for r in df.collect())
    assert ids(masks.coastline_filter(boxes, m, 0.5)) == [0, 1, 3, 4]  # exactly the threshold stays
    assert ids(masks.coastline_filter(boxes, m, 0.51)) == [0, 3, 4]
    assert ids(masks.buildings_filter(boxes, m, 0.5)) == [0, 2, 3, 4]  # exactly the threshold falls; a hole doesn't count
    assert ids(masks.mask_filter(boxes, m.where("kind = 'coastline'"), 0.0, "area_inside", tiny_stays=False)) == [0, 1, 2, 3]
    two = spark.createDataFrame([("a", "coastline", k, 0, pts(*sq(x))) for k, x in enumerate((0, 4, 30))], schema)
    parts = masks.dissolve(two).collect()
    assert sum(abs(area_of([(p["x"], p["y"]) for p in r["ring"]])) for r in parts) == pytest.approx(240)
    with pytest.raises(ValueError):
        masks.mask_filter(boxes, m, 0.5, "other")


def test_tiles(spark):
    df = spark.createDataFrame([("a", 640, 100), ("b", 1000, 640), ("c", 0, 5)], "image string, width int, height int")
    got = {(r["image"], r["x_off"], r["w"]) for r in tiling.tile_grid(df, 640, 64).where("row = 0").collect()}
    assert got == {("a", 0, 640), ("a", 576, 64), ("b", 0, 640), ("b", 576, 424)}
    names = spark.createDataFrame([("image_a_0_640",), ("image_a_640",), ("scene_1_2_3",)], "tile string")
    assert sorted(tuple(r)[1:] for r in tiling.parse_tile_names(names).collect()) == [("image_a", 0, 640), ("scene_1", 2, 3)]
    with pytest.raises(ValueError):
        tiling.tile_grid(df, 64, 64)


def test_halo(spark):
    df = spark.createDataFrame([("a", 500, 300)], "image string, width int, height int")
    rows = tiling.halo_crop(tiling.output_window(tiling.halo_grid(df, 200, 40), 2.0), 2.0).collect()
    assert sum(r["core_w"] * r["core_h"] for r in rows) == 500 * 300
    assert all(0 <= r["read_x"] <= r["core_x"] and r["read_x"] + r["read_w"] <= 500 and r["read_w"] <= r["core_w"] + 40 for r in rows)
    assert sum(r["out_w"] for r in rows if r["core_y"] == 0) == 250
    assert sum(r["out_w"] * r["out_h"] for r in rows) == 250 * 150
    assert all((r["crop_x"], r["crop_y"]) == ((r["core_x"] - r["read_x"]) // 2, (r["core_y"] - r["read_y"]) // 2) for r in rows)


def test_uniform_tiles(spark):
    df = spark.createDataFrame([("a", 6, 4), ("b", 4, 4)], "image string, width int, height int")
    blocks = spark.createDataFrame([("a", 0, r, [7] * 6) for r in range(4)] + [("b", 0, r, [7] * 4) for r in range(4)], "image string, band int, row_off int, pixels array<int>")
    kept = tiling.tile_pixels(blocks, tiling.tile_grid(df, 4), 4)
    assert {r["tile"] for r in kept.select("tile").distinct().collect()} == {"a_4_0"}  # the edge tile is filled with 0
    assert {tuple(r["pixels"]) for r in kept.collect()} == {(7, 7, 0, 0)}


def test_labels(spark):
    raw = ["0 0.1 0.1 0.2 0.1 0.2 0.15 0.1 0.15", "", "0 1 2", "0.0 1 2 3 4 5 6 7 8", "0 a 1 1 1 1 1 1 1", " 3\t1 2 3 4 5 6 7 8e-1 ", "1 " + "0.5 " * 9]
    lines = spark.createDataFrame([("i", k, t) for k, t in enumerate(raw)], "image string, line_no int, raw string")
    parsed = labels.parse(lines).orderBy("line_no").collect()
    assert [(r["line_no"], r["class_id"]) for r in parsed] == [(0, 0), (5, 3)] and parsed[1]["corners"][3]["y"] == 0.8
    text = labels.format_lines(labels.parse(lines)).orderBy("line_no").first()["line"]
    assert text == "0 0.100000 0.100000 0.200000 0.100000 0.200000 0.150000 0.100000 0.150000"
    prof = labels.class_profile(lines).collect()
    assert [(r["class_id"], r["n"]) for r in prof] == [(0, 2)]  # up to the first bad token
    files = labels.files(labels.parse(lines), spark.createDataFrame([("i",), ("j",)], "image string"))
    got = dict(files.collect())
    assert got["j"] == "" and got["i"].endswith("\n") and got["i"].count("\n") == 2


def test_project_labels(spark):
    images = spark.createDataFrame([("a", 100, 100)], "image string, width int, height int")
    tiles = tiling.tile_grid(images, 50, 10)
    rng = random.Random(7)
    rows = [("a", k, 0, pts(*[(x / 10, y / 10) for x, y in box(rng)])) for k in range(40)]
    df = spark.createDataFrame(rows, f"image string, line_no int, class_id int, corners {RING}")
    all_tiles = [(r["tile"], r["x_off"], r["y_off"]) for r in tiles.collect()]
    for t in (0.0, 0.1, 0.6):
        want = set()
        for _, k, _, c in rows:
            p = [(q["x"] * 100, q["y"] * 100) for q in c]
            for name, x, y in all_tiles:
                if abs(area_of(clip_of(p, [(x, y), (x + 50, y), (x + 50, y + 50), (x, y + 50)]))) / abs(area_of(p)) >= t:
                    want.add((name, k))
        got = tiling.project_labels(df, tiles, 50, 10, t)
        assert {(r["tile"], r["line_no"]) for r in got.collect()} == want


def test_annotations(spark):
    schema = f"image string, ordinal int, class_id int, ring {RING}"
    rows = [("a", 0, 0, pts((10, 10), (20, 10), (20, 16), (10, 16))), ("a", 1, 9, pts((10, 10), (20, 10), (20, 16))), ("a", 2, 7, pts((1, 1), (2, 1), (2, 2))),
            ("a", 3, None, pts((1, 1), (2, 1), (2, 2))), ("a", 4, 2, pts((200, 200), (210, 200), (210, 210))), ("z", 5, 0, pts((1, 1), (2, 1), (2, 2)))]
    t = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 1.0, "f": 0.0}
    images = spark.createDataFrame([("a", 100, 50, "EPSG:4326", tuple(t.values()))], "image string, width int, height int, crs string, affine struct<a:double,b:double,c:double,d:double,e:double,f:double>")
    cfg = annotate.AnnotationConfig({0: 4, 2: 1, 9: 2}, (9,))
    got = annotate.convert(spark.createDataFrame(rows, schema), images, cfg).collect()
    assert [(r["ordinal"], r["class_id"]) for r in got] == [(0, 4)]
    assert sorted((round(p["x"], 6), round(p["y"], 6)) for p in got[0]["corners"]) == [(0.1, 0.2), (0.1, 0.32), (0.2, 0.2), (0.2, 0.32)]


def test_split(spark):
    n = spark.createDataFrame([(k,) for k in (1, 2, 3, 7, 10, 20, 100)], "n long")
    got = {}
    for r in split.capacities(n, (0.7, 0.15, 0.15)).collect():
        got.setdefault(r["n"], {})[r["split"]] = r["capacity"]
    want = {1: (1, 0, 0), 2: (2, 0, 0), 3: (2, 1, 0), 7: (5, 1, 1), 10: (7, 2, 1), 20: (14, 3, 3), 100: (70, 15, 15)}
    assert {k: tuple(v[s] for s in split.SPLITS) for k, v in got.items()} == want
    images = spark.createDataFrame([(f"i{k:02d}",) for k in range(20)], "image string")
    profile = spark.createDataFrame([(f"i{k:02d}", k % 3, 1 + k % 4) for k in range(18)], "image string, class_id int, n long")
    out = dict(split.assign(images, profile, split.SplitConfig(priority=(0,))).collect())
    assert len(out) == 20 and [list(out.values()).count(s) for s in split.SPLITS] == [14, 3, 3]
    assert out == dict(split.assign(images, profile, split.SplitConfig(priority=(0,))).collect())
    with pytest.raises(ValueError):
        split.SplitConfig(ratios=(0.5, 0.2, 0.2))


@pytest.mark.parametrize("ties", ["random", "first"])
def test_split_in_batches(spark, ties):
    """The global order of the greedy rule, read in batches and never as one group."""
    rng = random.Random(3)
    found = {f"i{k:03d}": {c: rng.randint(1, 6) for c in rng.sample(range(5), rng.randint(0, 3))} for k in range(90)}
    images = spark.createDataFrame([(k,) for k in found], "image string")
    profile = spark.createDataFrame([(k, c, n) for k, p in found.items() for c, n in p.items()], "image string, class_id int, n long")
    cfg = split.SplitConfig(priority=(0, 3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = split.assign(images, profile, cfg, ties)
        got = dict(out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == split.greedy({k: dict(sorted(p.items())) for k, p in found.items()}, cfg, ties)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_seeded_ties():
    """All images without labels tie everywhere, so the draws are those of the seeded generator."""
    got = split.greedy({f"i{k}": {} for k in range(8)}, split.SplitConfig(ratios=(0.34, 0.33, 0.33)), "random")
    rng, room, want = random.Random(42), {"train": 3, "val": 3, "test": 2}, []
    for _ in range(8):
        s = rng.choice([s for s in split.SPLITS if room[s]])
        room[s] -= 1
        want.append(s)
    assert list(got.values()) == want


def test_stretch(spark):
    df = spark.createDataFrame([("a", v) for v in [0, -5, *range(1, 101)]] + [("b", 0), ("c", 7)], "image string, value int")
    p = {r["image"]: (r["lo"], r["hi"]) for r in raster.stretch_params(df, ["image"], 1, 99).collect()}
    assert p["a"] == pytest.approx(tuple(np.percentile(np.arange(1, 101), [1, 99]))) and p["b"] == (0, 1) and p["c"] == (7, 8)
    blocks = spark.createDataFrame([("a", b, 0, 0, 1, 100, list(range(100))) for b in range(4)], rasters.BLOCKS)
    out = raster.radiometric(blocks, gamma=0.8).collect()
    assert sorted(r["band"] for r in out) == [0, 1, 2] and all(r["pixels"][0] == 1 and r["pixels"][99] == 254 for r in out)
    one = raster.radiometric(blocks.where("band = 0")).collect()
    assert sorted(r["band"] for r in one) == [0, 1, 2]


def test_resampling(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 255, (6, 8))
    rows = spark.createDataFrame([("a", 0, r, [int(v) for v in a[r]]) for r in range(6)], "image string, band int, row_off int, pixels array<int>")
    got = raster.resample_nearest(rows, 1.5).orderBy("row_off").collect()
    want = a[np.minimum((np.arange(9) + 0.5) * 6 / 9, 5).astype(int)][:, np.minimum((np.arange(12) + 0.5) * 8 / 12, 7).astype(int)]
    assert [r["pixels"] for r in got] == want.tolist()
    for m in raster.METHODS:
        w = raster.axis_weights(10, 25, m)
        assert np.allclose(w.sum(1), 1) and np.allclose(w @ np.full(10, 3.0), 3)
        t = spark.createDataFrame([("a", 0, 0, 0, 6, 8, a.reshape(-1).tolist())], rasters.BLOCKS)
        r = raster.resample_tiles(t, 2.0, m).first()
        assert (r["h"], r["w"], len(r["pixels"])) == (12, 16, 192)
    with pytest.raises(ValueError):
        raster.resample_tiles(rows, 2.0, "other")


def test_whole_grids_tiles_and_rows(spark, sf):
    """The queries without a filter against loops over both axes, all lines and all rows."""
    from tessera.plans import derived, queries

    def axis(n):
        for at in range(0, n, 224):
            core, before = min(224, n - at), min(at, 16)
            wide = core + before + min(n - at - core, 32 - before)
            yield at, core, at - before, wide, round(at / 0.3), max(1, round((at + core) / 0.3) - round(at / 0.3)), round(before / 0.3)

    want = [
        (r["image"], x, y, w, h, rx, ry, rw, rh, ox, oy, ow, oh, cx, cy)
        for r in derived.images(spark, sf).collect()
        for x, w, rx, rw, ox, ow, cx in axis(r["width"])
        for y, h, ry, rh, oy, oh, cy in axis(r["height"])
    ]
    assert sorted(map(tuple, queries.halo_grid_all(spark, sf).collect())) == sorted(want)
    rows = {r["image"]: r["pixels"] for r in derived.embedding_rows(spark, sf).collect()}
    tiles, resampled = [], []
    for image, pixels in rows.items():
        for x in range(0, len(pixels), 18):
            part = pixels[x : x + 18]
            line = part + [0] * (18 - len(part))
            if len(set(line)) > 1:
                tiles += [(image, f"{image}_{x}_0", 0, k, line) for k in range(18)]
        new = int(np.rint(len(pixels) * 1.5))
        resampled += [(image, 0, k, i + 1, pixels[min(int((i + 0.5) * len(pixels) / new), len(pixels) - 1)]) for k in range(2) for i in range(new)]
    assert sorted(map(tuple, queries.uniform_tile_filter_all(spark, sf).collect())) == sorted(tiles)
    assert sorted(map(tuple, queries.resample_nearest_all(spark, sf).collect())) == sorted(resampled)


def test_kernels_and_blur():
    for kind in ("gaussian", "generalised", "plateau", "sinc"):
        k = raster.blur_kernel(kind, 9, 1.5, 1.0, 0.3)
        assert k.sum() == pytest.approx(1) and np.allclose(k, k[::-1, ::-1]) and k[4, 4] == k.max()
    assert np.allclose(raster.blur_kernel("generalised", 7, beta=1.0), raster.blur_kernel("gaussian", 7))
    k = raster.blur_kernel("gaussian", 5, 1.0, 2.0, 0.7)
    image = np.zeros((15, 17))
    image[7, 8] = 1
    assert np.allclose(raster.masked_blur(image, np.ones_like(image, bool), k)[5:10, 6:11], k)  # the response is the kernel
    flat = raster.masked_blur(np.full((9, 9), 5.0), np.arange(81).reshape(9, 9) % 7 > 0, k)
    assert np.allclose(flat, 5)
    assert raster.bessel_j1(np.array([0.0, 1.0, 5.0])) == pytest.approx([0, 0.4400505857, -0.3275791376])


def test_degrade_repeats(spark):
    rng = np.random.default_rng(1)
    t = spark.createDataFrame([("a", k, 2, 8, 8, rng.integers(0, 255, 128).tolist()) for k in range(6)], "image string, tile_no int, n_bands int, h int, w int, pixels array<int>")
    steps = [{"op": "blur", "blur_type_weights": {"gaussian": 1, "sinc_mtf": 2}}, {"op": "noise"}, {"op": "resize", "scale": 2.0}]
    one = sorted(map(str, raster.degrade(t, steps, 3).collect()))
    assert one == sorted(map(str, raster.degrade(t.repartition(5), steps, 3).collect()))
    assert all(r["h"] == 4 and min(r["pixels"]) >= 0 and max(r["pixels"]) <= 255 for r in raster.degrade(t, steps, 3).collect())
    assert raster.spatial_scale(steps) == 2.0
    with pytest.raises(ValueError):
        raster.degrade_tile(np.zeros((1, 2, 2)), None, [{"op": "other"}], 0)


def test_grid(spark):
    runs = grid.runs(spark)
    assert runs.count() == 36 and runs.select("preproc_key").distinct().count() == 6 and runs.select("tiling_key").distinct().count() == 18
    assert runs.where("run_id = 'up2_t1024_cl6_p2'").count() == 1
    steps = grid.steps(runs)
    assert [r["index"] for r in steps.orderBy("index").collect()] == list(range(60))
    failed = spark.createDataFrame([("preproc", "up1_cl6", False), ("tiling", "up2_t640_cl4", True), ("train", "up1_t640_cl6_std", True)], "stage string, key string, oom boolean")
    out = {r["run_id"]: (r["status"], r["failed_stage"]) for r in grid.outcomes(runs, failed).collect()}
    assert out["up1_t640_cl6_std"] == ("failed", "preproc") and out["up2_t640_cl4_p2"] == ("oom", "tiling") and out["up4_t640_cl4_p2"] == ("success", None)
    log = spark.createDataFrame([("x CUDA Out of Memory",), ("fine",), (None,)], "t string")
    assert [r[0] for r in log.select(grid.is_out_of_memory(F.col("t"))).collect()] == [True, False, False]


def test_geojson_files(spark, tmp_path):
    sq = pts((0, 0), (4, 0), (4, 4), (0, 4))
    rows = spark.createDataFrame(
        [("a", 0, "FN", 1, "c", None, "t", sq), ("a", 1, "TP", 0, "d", 0.123456, None, sq)],
        f"image string, ordinal int, label string, class_id int, class_name string, confidence double, source_tile string, ring {RING}",
    )
    text = geojson.collections(rows).first()["value"]
    assert text.index('"TP"', text.index("features")) < text.index('"FN"', text.index("features"))
    assert '"confidence":null' in text and '"confidence":0.1235' in text and text.count("source_tile") == 1
    f = tmp_path / "scene_1.geojson"
    f.write_text(text.replace("}]}", '},{"type":"Feature","properties":{"class_id":3},"geometry":null},{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}'))
    (tmp_path / "empty.geojson").write_text('{"type":"FeatureCollection"}')
    got = geojson.read_features(spark, str(tmp_path))
    assert got.count() == 4
    good = geojson.valid_detections(got, {0: "zero"}).orderBy("ordinal").collect()
    assert [(r["image"], r["class_name"], len(r["ring"])) for r in good] == [("scene_1", "zero", 4), ("scene_1", "1", 4)]
    assert geojson.valid_detections(got, truth=True).where("confidence is not null").count() == 0
    assert geojson.polygons(spark, str(f), "coastline").count() == 3
    many = tmp_path / "masks" / "scene_2.geojson"
    many.parent.mkdir()
    square = lambda x: f"[[{x},0],[{x + 2},0],[{x + 2},2],[{x},2],[{x},0]]"
    feature = '{{"type":"Feature","properties":{{}},"geometry":{{"type":"{}","coordinates":{}}}}}'.format
    parts = feature("MultiPolygon", f"[[{square(0)}],[{square(5)},{square(5.5)}]]")
    many.write_text('{"features":[' + ",".join([feature("Polygon", f"[{square(9)}]"), parts, feature("Point", "[1,2]"), '{"geometry":null}']) + "]}")
    rings = geojson.polygons(spark, str(many), "coastline").orderBy("polygon_id", "ring_id").collect()
    assert [(r["polygon_id"], r["ring_id"], r["ring"][0]["x"]) for r in rings] == [(0, 0, 9), (1, 0, 0), (2, 0, 5), (2, 1, 5.5)]
    geojson.write_collections(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_files_and_labels_on_disk(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "i.txt").write_text("0 " + "0.5 " * 8 + "\n1 bad\n")
    (tmp_path / "in" / "e.txt").write_text("")
    lines = labels.read_lines(spark, str(tmp_path / "in"))
    assert [(r["image"], r["class_id"]) for r in labels.parse(lines).collect()] == [("i", 0)]
    assert [r["path"].rsplit("/", 1)[1] for r in rasters.list_files(spark, str(tmp_path / "in"), pattern="*.txt").collect()] == ["e.txt", "i.txt"]
    with pytest.raises(FileNotFoundError):
        rasters.list_files(spark, str(tmp_path / "in"))
    images = spark.createDataFrame([("i",), ("j",)], "image string")
    files = spark.createDataFrame([("/x/i.json",), ("/x/i.geojson",)], "path string")
    assert dict(rasters.sidecars(images, files).collect()) == {"i": "/x/i.geojson", "j": None}


def test_registry_and_config():
    r = Registry()
    r.stage("a")(lambda t, c: {"x": t["x"] + [c.get("v", 1)]})
    r.stage("b")(lambda t, c: {"x": t["x"] + ["b"]})
    cfg = Config({"stages": [{"name": "b", "enabled": False}, {"name": "a"}], "a": {"v": 5}})
    assert r.run({"x": []}, cfg)["x"] == [5] and r.run({"x": []}, cfg, only=["a", "b"])["x"] == ["b", 5]
    with pytest.raises(ValueError):
        r.run({}, Config({"stages": [{"name": "c"}]}))
    out = cfg.with_overrides(["a.v=2.5", "new.flag=TRUE", "nonsense", "a.n=7", "s=x"])
    assert out.to_dict()["a"] == {"v": 2.5, "n": 7} and out.new.flag is True and cfg.a.v == 5 and out["s"] == "x"
    assert Config.from_yaml("a:\n  b: 1\n").a.b == 1
    with pytest.raises(ValueError):
        Config.from_yaml("- 1\n- 2\n")
    assert set(postprocessing.stages) == {"coastline_filter", "buildings_filter"}


def test_predict_seam(spark):
    tiles = spark.createDataFrame([("a", k) for k in range(3)], "image string, n int")

    def detector(batches):
        for b in batches:
            b = b.assign(ordinal=b["n"], class_id=0, confidence=0.5 + b["n"] / 10)
            b["ring"] = [[{"x": float(x), "y": float(y)} for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))] for _ in range(len(b))]
            yield b[["image", "ordinal", "class_id", "confidence", "ring"]]

    assert [r["ordinal"] for r in predict({"tiles": tiles}, detector, Config()).collect()] == [2]


def test_stream(spark, tmp_path):
    from tessera.streaming.detections import read_detections, suppress_stream

    rows = scene(9, 40, images=1)
    frame(spark, rows).coalesce(1).write.json(str(tmp_path / "in"))
    q = suppress_stream(read_detections(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), 0.2)
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["ordinal"] for r in got.collect()) == nms_of(rows, 0.2)


def test_preprocessing_stages(spark):
    from tessera.plans.pipeline import preprocessing

    cfg = Config.from_yaml(
        "stages:\n  - name: spatial\n  - name: annotations\n  - name: split\n  - name: tiling\nspatial:\n  upscale_ratio: 2\n  interpolation: bilinear\n"
        "annotations:\n  class_map: {0: 0}\nsplit:\n  priority_class_ids: [0]\ntiling:\n  tile_size: 64\n  overlap: 0\n  splits: [train]\n"
    )
    affine = "affine struct<a:double,b:double,c:double,d:double,e:double,f:double>"
    images = spark.createDataFrame([("a", 50, 40, "EPSG:4326", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))], f"image string, width int, height int, crs string, {affine}")
    rows = [("a", 0, 0, pts((10, 10), (20, 10), (20, 16), (10, 16)))]
    tables = {
        "images": images,
        "annotations": spark.createDataFrame(rows, f"image string, ordinal int, class_id int, ring {RING}"),
        "blocks": spark.createDataFrame([("a", 0, 0, 0, 40, 50, [3] * 2000)], rasters.BLOCKS),
    }
    out = preprocessing.run(tables, cfg)
    assert out["blocks"].first()["w"] == 100 and {round(v) for v in out["blocks"].first()["pixels"]} == {3}
    assert out["tiles"].count() == 4 and {r["split"] for r in out["tiles"].collect()} == {"train"}
    got = out["tile_labels"].collect()
    assert [r["tile"] for r in got] == ["a_0_0"]
    assert sorted((round(p["x"] * 64, 6), round(p["y"] * 64, 6)) for p in got[0]["corners"]) == [(20, 20), (20, 32), (40, 20), (40, 32)]


def test_reports(spark, tmp_path):
    from tessera.operators import reports

    runs = grid.runs(spark)
    failed = spark.createDataFrame([("preproc", "up1_cl6", True)], "stage string, key string, oom boolean")
    lines = [r[0] for r in reports.run_summary(grid.outcomes(runs, failed)).collect()]
    assert len(lines) == 36 and lines[0] == "oom     up1_t640_cl6_std at preproc"
    assert reports.dataset_description("/d", {0: "a", 1: "b"}, "k")["names"] == ["a", "b"]
    with pytest.raises(ValueError):
        reports.dataset_description("/d", {1: "a"}, "k")
    (tmp_path / "s.csv").write_text("Model, Image, Class,TP\n30, west , Small , 5\n")
    r = reports.read_summary(spark, str(tmp_path / "s.csv")).first()
    assert (r["Model"], r["Image"], r["Class"], r["TP"]) == (30.0, "west", "Small", 5.0)
    reports.write_csv(metrics.table(spark.createDataFrame([(0, 1, 2, 3)], "class_id int, TP long, FP long, FN long")), str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).columns[-1] == "Bias (%)"
    a = spark.createDataFrame([("EPSG:32739",), ("EPSG:4326",)], "crs string")
    assert [r["crs"] for r in reports.shared_systems(a, a.where("crs like '%39'")).collect()] == ["EPSG:32739"]
    world = F.struct(*[F.lit(v).alias(k) for k, v in zip("abcdef", (0.01, 0.0, 40.0, 0.0, -0.01, -10.0))])
    df = spark.createDataFrame([(pts((0, 0), (1, 0), (1, 1), (0, 1)),)], f"r {RING}")
    got = df.select(reports.tile_to_wgs84(F.col("r"), F.lit(100.0), F.lit(200.0), 100, world, "EPSG:4326").alias("t"), reports.image_to_wgs84(F.col("r"), F.lit(100.0), F.lit(50.0), world, "WGS84").alias("i")).first()
    assert (got["t"][2]["x"], got["t"][2]["y"]) == pytest.approx((42.0, -13.0)) and (got["i"][2]["x"], got["i"][2]["y"]) == pytest.approx((41.0, -10.5))
