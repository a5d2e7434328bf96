import os
import random

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from tessera.functions import crs
from tessera.operators import masks, reports
from tessera.operators.ordinals import with_ordinals
from tessera.plans.pipeline import Config, checked, postprocessing, with_removed
from tessera.sources import tiff
from tests.test_geometry import RING, pts
from tests.test_operators import frame
from tests.test_tiff import META, meta_row
from tests.test_windows import BLOCKS, blocks_of


def test_any_mix_of_systems(spark):
    names = ["EPSG:4326", "wgs 84", "EPSG:32631", "epsg:32739", "EPSG:32760"]
    lonlat = {"EPSG:4326": (3.1, 45.2), "wgs 84": (3.1, 45.2), "EPSG:32631": (3.1, 45.2), "epsg:32739": (51.3, -12.1), "EPSG:32760": (177.0, -40.0)}
    rows = [(a, b, pts(lonlat[b], (lonlat[b][0] + 0.01, lonlat[b][1]))) for a in names[:2] for b in names]
    df = spark.createDataFrame([*rows, (None, "EPSG:4326", rows[0][2]), ("EPSG:4326", None, rows[0][2])], f"a string, b string, r {RING}")
    there = crs.reproject_between(F.col("r"), F.col("a"), F.col("b"))
    got = df.withColumn("t", there).withColumn("back", crs.reproject_between(F.col("t"), F.col("b"), F.col("a"))).collect()
    plain = lambda r: [(p["x"], p["y"]) for p in r]
    for r in got:
        if r["a"] is None or r["b"] is None:
            assert r["t"] is None
            continue
        want = df.where("a is not null").limit(1).select(crs.reproject(F.array(*[F.struct(F.lit(p["x"]).alias("x"), F.lit(p["y"]).alias("y")) for p in r["r"]]), r["a"], r["b"]).alias("v")).first()["v"]
        assert np.allclose(plain(r["t"]), plain(want)) and np.allclose(plain(r["back"]), plain(r["r"]))
    with pytest.raises(Exception, match="unsupported coordinate system: EPSG:32661"):
        df.select(crs.reproject_between(F.col("r"), F.lit("EPSG:4326"), F.lit("EPSG:32661"))).collect()


def test_masks_in_the_images_systems(spark):
    m = spark.createDataFrame([(i, "coastline", 0, 0, pts((3.0, 45.0), (3.1, 45.0), (3.1, 45.1))) for i in "abc"], f"image string, kind string, polygon_id int, ring_id int, ring {RING}")
    images = spark.createDataFrame([("a", "EPSG:32631"), ("b", "EPSG:4326"), ("c", None)], "image string, crs string")
    got = {r["image"]: r["ring"][0] for r in masks.masks_in(m, images).collect()}
    assert set(got) == {"a", "b"} and got["b"]["x"] == 3.0 and got["a"]["x"] == pytest.approx(500000.0, abs=1e-6)


def test_ordinals(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "name string, n int, k int").repartition(5)
    got = sorted((r["ordinal"], r["name"], r["n"]) for r in with_ordinals(df, "name", F.desc("n")).collect())
    assert got == [(i, a, n) for i, (a, n) in enumerate(sorted(((a, n) for a, n, _ in rows), key=lambda r: (r[0], -r[1])))]
    one = with_ordinals(spark.createDataFrame([(7,)] * 40, "n int").repartition(4), "n")
    assert sorted(r["ordinal"] for r in one.collect()) == list(range(40))
    assert with_ordinals(df.where("false"), "n").count() == 0


def test_checked_settings():
    good = {"pipeline": {"mode": "inference"}, "model": {}, "paths": {}, "prediction": {"conf": 0.2}}
    assert checked(Config(good)).pipeline.mode == "inference"
    with pytest.raises(KeyError, match="model"):
        checked(Config({k: v for k, v in good.items() if k != "model"}))
    for part in ({"pipeline": {"mode": "other"}}, {"prediction": {"conf": 1.5}}, {"prediction": {"global_nms_iou": "x"}}, {"evaluation": {"iou_threshold": True}}):
        with pytest.raises(ValueError):
            checked(Config({**good, **part}))


def test_removed_by_stage(spark):
    sq = lambda x: [(x, 0), (x + 10, 0), (x + 10, 10), (x, 10)]
    b = frame(spark, [("a", 0, 0, 0.5, sq(0)), ("a", 1, 0, 0.5, sq(50)), ("a", 2, 0, 0.5, sq(20)), ("b", 0, 0, 0.5, sq(0))])
    m = spark.createDataFrame([("a", "coastline", 0, 0, pts((0, 0), (40, 0), (40, 10), (0, 10))), ("a", "buildings", 0, 0, pts(*sq(20)))], f"image string, kind string, polygon_id int, ring_id int, ring {RING}")
    cfg = Config({"stages": [{"name": "coastline_filter"}, {"name": "buildings_filter"}]})
    tables, counts = with_removed(postprocessing, {"predictions": b, "masks": m}, cfg)
    assert sorted((r["image"], r["ordinal"]) for r in tables["predictions"].collect()) == [("a", 0), ("b", 0)]
    got = {(r["stage"], r["image"]): r["removed"] for r in counts.collect()}
    assert got == {("coastline_filter", "a"): 1, ("coastline_filter", "b"): 0, ("coastline_filter", None): 1, ("buildings_filter", "a"): 1, ("buildings_filter", "b"): 0, ("buildings_filter", None): 1}
    assert with_removed(postprocessing, {"predictions": b, "masks": m}, cfg, [])[1].count() == 0


def test_dataset_file_and_folder_system(spark, tmp_path):
    root = str(tmp_path / "d")
    reports.write_dataset(spark, root, {0: "a", 1: "é"}, "k")
    assert yaml.safe_load(open(f"{root}/dataset.yaml", encoding="utf-8"))["names"] == ["a", "é"] and os.listdir(root) == ["dataset.yaml"]
    assert tiff.folder_crs(spark, root) is None
    a = np.zeros((1, 4, 4))
    tiff.write_tiff(spark.createDataFrame(blocks_of({"x": a, "y": a}, 4, 4), BLOCKS), spark.createDataFrame([meta_row("x", a, "uint8", crs="EPSG:32739"), meta_row("y", a, "uint8")], META), root)
    assert tiff.folder_crs(spark, root) == "EPSG:32739"
