import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import raster, tiling, windows

BLOCKS = "image string, band int, row_off int, col_off int, h int, w int, pixels array<double>"


def blocks_of(images, bh, bw):
    """Block rows of ``{name: (bands, h, w)}``."""
    out = []
    for name, a in images.items():
        for band in range(a.shape[0]):
            for y in range(0, a.shape[1], bh):
                for x in range(0, a.shape[2], bw):
                    p = a[band, y : y + bh, x : x + bw]
                    out.append((name, band, y, x, *p.shape, [float(v) for v in p.reshape(-1)]))
    return out


def image_of(rows, name, shape):
    out, seen = np.full(shape, np.nan), np.zeros(shape, int)
    for r in rows:
        if r["image"] == name:
            at = r["band"], slice(r["row_off"], r["row_off"] + r["h"]), slice(r["col_off"], r["col_off"] + r["w"])
            out[at] = np.reshape(r["pixels"], (r["h"], r["w"]))
            seen[at] += 1
    assert (seen == 1).all()  # neither gaps nor overlaps
    return out


def tables(spark, images, bh, bw, **more):
    sizes = [(n, a.shape[2], a.shape[1], *more.values()) for n, a in images.items()]
    return spark.createDataFrame(blocks_of(images, bh, bw), BLOCKS).repartition(3), spark.createDataFrame(sizes, "image string, width int, height int" + "".join(f", {k} {'string' if isinstance(v, str) else 'double'}" for k, v in more.items()))


@pytest.mark.parametrize("method", raster.METHODS)
@pytest.mark.parametrize("scale", [0.37, 1.0, 1.7, 3.0])
def test_blocks_scale_like_one(spark, method, scale):
    rng = np.random.default_rng(3)
    images = {"a": rng.uniform(0, 255, (2, 23, 31)), "b": rng.uniform(0, 255, (1, 7, 40)), "c": rng.uniform(0, 9, (1, 1, 1))}
    for bh, bw in ((8, 8), (1, 40)) if scale != 1.7 else ((5, 3),):
        got = windows.resample(*tables(spark, images, bh, bw), scale, method).collect()
        for name, a in images.items():
            h, w = (max(1, int(np.rint(n * scale))) for n in a.shape[1:])
            wy, wx = raster.axis_weights(a.shape[1], h, method), raster.axis_weights(a.shape[2], w, method)
            assert np.allclose(image_of(got, name, (len(a), h, w)), wy @ a @ wx.T)


def test_tiles_from_any_blocks(spark):
    rng = np.random.default_rng(5)
    images = {"a": rng.integers(1, 200, (3, 20, 17)).astype(float), "flat": np.full((1, 10, 10), 7.0)}
    blocks, sizes = tables(spark, images, 6, 5)
    tiles = tiling.tile_grid(sizes, 8, 2)
    got = windows.cut_tiles(blocks, tiles, 8, 0.0).collect()
    assert {r["image"] for r in got if r["tile"].endswith("_0_0")} == {"a"}  # uniform tiles go, padded ones are not uniform
    for r in got:
        a = np.zeros((8, 8))
        part = images[r["image"]][r["band"], r["row_off"] : r["row_off"] + 8, r["col_off"] : r["col_off"] + 8]
        a[: part.shape[0], : part.shape[1]] = part
        assert r["pixels"] == a.reshape(-1).tolist()
    assert len(windows.cut_tiles(blocks, tiles, 8, keep_uniform=True).collect()) == tiles.where("image = 'a'").count() * 3 + tiles.where("image = 'flat'").count()


def test_windows_touch_only_their_blocks(spark):
    images = {"a": np.arange(400.0).reshape(1, 20, 20)}
    blocks, _ = tables(spark, images, 5, 5)
    asked = spark.createDataFrame([("a", 1, 3, 4, 4, 7), ("a", 2, 0, 0, 5, 5), ("a", 3, 30, 30, 2, 2), ("z", 4, 0, 0, 2, 2), ("a", 5, 2, 2, 0, 3)], "image string, window int, y int, x int, height int, width int")
    rows = {r["window"]: r for r in windows.gather(blocks, asked).collect()}
    assert set(rows) == {1, 2} and len(rows[1]["strips"]) == 6 and len(rows[2]["strips"]) == 1
    a = windows.assembled(rows[1]["strips"], 4, 7)
    assert (a[0] == images["a"][0, 3:7, 4:11]).all()
    ragged = spark.createDataFrame([("a", 0, 0, 0, 4, 4, [0.0] * 16), ("a", 0, 3, 0, 2, 4, [0.0] * 8)], BLOCKS)
    with pytest.raises(Exception, match="not on the grid"):
        windows.gather(ragged, asked).collect()


STEPS = [{"op": "blur", "kernel_sizes": [3], "blur_type_weights": {"gaussian": 1.0, "plateau": 1.0}}, {"op": "noise", "prob": 0.7}, {"op": "resize", "scale": 2.0}]


@pytest.mark.parametrize("dtype, top", [("uint8", 255), ("uint16", 65535), ("float32", 1)])
def test_images_are_degraded_whole(spark, dtype, top):
    rng = np.random.default_rng(1)
    images = {"a": np.trunc(rng.uniform(0, top, (2, 37, 30))) if top > 1 else rng.uniform(0, 1, (2, 37, 30))}
    one = windows.degrade_images(*tables(spark, images, 37, 30, dtype=dtype), STEPS, 16, 4, seed=3).collect()
    many = windows.degrade_images(*tables(spark, images, 7, 11, dtype=dtype), STEPS, 16, 4, seed=3).collect()
    shape = (2, 18, 15)
    a, b = image_of(one, "a", shape), image_of(many, "a", shape)
    assert (a == b).all()  # how the image is stored doesn't matter
    if top > 1:
        assert (a == np.trunc(a)).all() and a.min() >= 0 and a.max() <= top
    # each core is that of its halo tile degraded alone
    tile = raster.degrade_tile(images["a"][:, :16, :16] / top, None, STEPS, 3 * 65537)
    core = np.trunc(np.clip(tile * top, 0, top)) if top > 1 else tile * top
    assert np.allclose(a[:, :6, :6], core[:, :6, :6], atol=1e-9 if top == 1 else 1)


def test_draws_follow_the_settings():
    """The order of draws: kind, size, both sigmas, angle, then only what the kind needs; Poisson's scale before its field."""
    step = {"blur_type_weights": {"gaussian": 0.0, "generalized_gaussian": 1.0}, "kernel_sizes": [5, 7], "sigma_x": (1, 2), "sigma_y": (2, 3), "theta_range": (0, 1), "beta_range": (0.5, 4)}
    rng = np.random.default_rng(9)
    rng.choice(2, p=[0.0, 1.0])
    size = int(rng.choice([5, 7]))
    sx, sy, theta, beta = rng.uniform(1, 2), rng.uniform(2, 3), rng.uniform(0, 1), rng.uniform(0.5, 4)
    assert np.array_equal(raster.sampled_kernel(np.random.default_rng(9), step), raster.blur_kernel("generalised", size, sx, sy, theta, beta))
    bands, valid = np.full((2, 4, 4), 3.0), np.ones((2, 4, 4), bool)
    valid[0, 0, 0] = False
    rng = np.random.default_rng(2)
    rng.random(), rng.random()
    scale = rng.uniform(0.5, 0.6)
    want = np.stack([3 + (rng.poisson(np.full((4, 4), 3.0)) - 3.0) * scale for _ in range(2)])
    want[0, 0, 0] = 3
    got = raster.noisy(bands, valid, np.random.default_rng(2), {"gray_prob": 0.0, "gaussian_prob": 0.0, "poisson_scale_range": (0.5, 0.6)})
    assert np.allclose(got, want)
    with pytest.raises(ValueError):
        raster.sampled_kernel(np.random.default_rng(0), {"blur_type_weights": {"other": 1}})
    with pytest.raises(ValueError):
        raster.degrade_tile(bands, None, [{"op": "resize", "scale": 2, "methods": ["other"]}], 0)
    with pytest.raises(ValueError):
        raster.pixel_range("complex64")


def test_spatial_stage_of_several_blocks(spark):
    from tessera.plans.pipeline import Config, preprocessing

    a = np.arange(240.0).reshape(1, 12, 20)
    blocks, images = tables(spark, {"a": a}, 5, 6)
    out = preprocessing.run({"blocks": blocks, "images": images}, Config({"stages": [{"name": "spatial"}], "spatial": {"upscale_ratio": 2.0, "interpolation": "bilinear"}}))
    got = image_of(out["blocks"].collect(), "a", (1, 24, 40))
    assert np.allclose(got[0], raster.axis_weights(12, 24, "bilinear") @ a[0] @ raster.axis_weights(20, 40, "bilinear").T)
    assert out["images"].select("width", "height").first() == (40, 24)
    tiled = preprocessing.run(
        {"blocks": blocks, "images": images, "labels": spark.createDataFrame([], "image string, line_no int, class_id int, corners array<struct<x:double,y:double>>")},
        Config({"stages": [{"name": "tiling"}], "tiling": {"tile_size": 8, "overlap": 0}}),
    )
    assert tiled["tile_pixels"].count() == tiled["tiles"].count() == 6 and tiled["tile_pixels"].agg(F.max(F.size("pixels"))).first()[0] == 64
