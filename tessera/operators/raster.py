"""Raster operators on block tables: ``image, band, row_off, col_off, h, w, pixels``."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import scaled_affine

METHODS = ("nearest", "bilinear", "cubic", "lanczos")


def band_channels(bands: DataFrame, chosen: tuple[int, ...] | None = None) -> DataFrame:
    """``image, channel, band``: three source bands for each image, from ``image, n_bands``.

    Chosen bands count from 1.  Without a choice the first three serve, or the
    first one three times where there are fewer.
    """
    channel = F.posexplode(F.array(*[F.lit(b - 1) for b in chosen]) if chosen else F.expr("if(n_bands >= 3, array(0, 1, 2), array(0, 0, 0))"))
    out = bands.select("image", "n_bands", channel.alias("channel", "band"))
    if chosen:
        bad = F.raise_error(F.format_string("band %d of %d", F.col("band") + 1, F.col("n_bands")))
        out = out.withColumn("band", F.when((F.col("band") < 0) | (F.col("band") >= F.col("n_bands")), bad.cast("int")).otherwise(F.col("band")))
    return out.select("image", "channel", "band")


def stretch_params(pixels: DataFrame, key: list[str], lo: float = 1.0, hi: float = 99.9, value: str = "value") -> DataFrame:
    """Exact percentiles of the positive pixels of each key: ``lo, hi``.

    Without a positive pixel they are 0 and 1; a range without width becomes
    one wide.  Keys are those of the input, also where no pixel counts.
    """
    v = F.when(F.col(value) > 0, F.col(value).cast("double"))
    p = pixels.groupBy(*key).agg(F.percentile(v, F.array(F.lit(lo / 100), F.lit(hi / 100))).alias("p"))
    low, high = F.coalesce(F.col("p")[0], F.lit(0.0)), F.coalesce(F.col("p")[1], F.lit(1.0))
    return p.select(*key, low.alias("lo"), F.when(high <= low, low + 1.0).otherwise(high).alias("hi"))


def stretched(v: Column, lo: Column, hi: Column, gamma: float = 1.0) -> Column:
    """A pixel in 1..254, in single precision and truncated."""
    f = lambda c: c.cast("float")
    share = F.greatest(f(F.lit(0.0)), F.least(f(F.lit(1.0)), f(f(f(v) - f(lo)) / f(f(hi) - f(lo)))))
    if gamma != 1.0:
        share = f(F.pow(share, F.lit(gamma)))
    return F.greatest(F.lit(1), F.least(F.lit(254), f(f(share * f(F.lit(253.0))) + f(F.lit(1.0))).cast("int")))


def radiometric(blocks: DataFrame, lo: float = 1.0, hi: float = 99.9, gamma: float = 1.0, bands: tuple[int, ...] | None = None) -> DataFrame:
    """Three 8-bit channels for each image: percentile stretch and gamma, block by block.

    Parameters are a row for each image and band; blocks stay where they are
    and are only joined with them.
    """
    pixels = blocks.select("image", "band", F.explode("pixels").alias("value"))
    params = stretch_params(pixels, ["image", "band"], lo, hi)
    channels = band_channels(blocks.groupBy("image").agg((F.max("band") + 1).alias("n_bands")), bands)
    table = channels.join(params, ["image", "band"])
    out = blocks.join(table, ["image", "band"])
    return out.select(
        "image", F.col("channel").alias("band"), "row_off", "col_off", "h", "w",
        F.transform("pixels", lambda v: stretched(v, F.col("lo"), F.col("hi"), gamma)).alias("pixels"),
    )


# ---------------------------------------------------------------- resampling


def scaled_size(length: Column, scale: float) -> Column:
    return F.greatest(F.lit(1), F.rint(length * scale).cast("int"))


def scaled_meta(images: DataFrame, scale: float) -> DataFrame:
    """``width, height`` and ``affine`` after scaling; the affine uses the scales of the whole sizes."""
    if scale <= 0:
        raise ValueError("scale must be above 0")
    out = images.withColumns({"new_width": scaled_size(F.col("width"), scale), "new_height": scaled_size(F.col("height"), scale)})
    sx, sy = F.col("new_width") / F.col("width"), F.col("new_height") / F.col("height")
    out = out.withColumns({"sx": sx, "sy": sy})
    return out.withColumn("affine", scaled_affine(F.col("affine"), F.col("sx"), F.col("sy"))) if "affine" in images.columns else out


def nearest_row(pixels: Column, width: Column, new_width: Column) -> Column:
    """One row of pixels at a new width: the pixel under each new pixel's centre."""
    at = lambda i: F.least(F.floor((i + 0.5) * width / new_width), width - 1)
    return F.transform(F.sequence(F.lit(0), new_width - 1), lambda i: F.element_at(pixels, (at(i) + 1).cast("int")))


def resample_nearest(rows: DataFrame, scale: float) -> DataFrame:
    """Nearest-neighbour scaling of whole rows ``image, band, row_off, pixels``.

    Every new row takes one old row, found by arithmetic: an equi-join on the
    row number.
    """
    size = rows.groupBy("image").agg((F.max("row_off") + 1).alias("height"), F.max(F.size("pixels")).alias("width"))
    size = scaled_meta(size, scale)
    new = size.withColumn("new_row", F.explode(F.sequence(F.lit(0), F.col("new_height") - 1)))
    source = F.least(F.floor((F.col("new_row") + 0.5) * F.col("height") / F.col("new_height")), F.col("height") - 1).cast("int")
    new = new.select("image", "width", "new_width", "new_row", source.alias("row_off"))
    return rows.join(new, ["image", "row_off"]).select(
        "image", "band", F.col("new_row").alias("row_off"), nearest_row(F.col("pixels"), F.col("width"), F.col("new_width")).alias("pixels")
    )


def _kernel(method: str, t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    if method == "area":
        return (t <= 0.5).astype(float)
    if method == "bilinear":
        return np.maximum(0.0, 1 - t)
    if method == "cubic":  # Keys, a = -1/2
        return np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))
    if method == "lanczos":
        return np.where(t < 3, np.sinc(t) * np.sinc(t / 3), 0.0)
    raise ValueError(f"unknown method: {method}")


def axis_weights(length: int, new: int, method: str, rows: slice = slice(None), cols: slice = slice(None)) -> np.ndarray:
    """A (new, length) matrix of interpolation weights, or a part of it; shrinking widens the kernel.

    The part's columns must hold all that its rows weigh.
    """
    at, old = np.arange(new)[rows], np.arange(length)[cols]
    if method == "nearest":
        return (np.minimum(((at + 0.5) * length / new).astype(int), length - 1)[:, None] == old).astype(float)
    stretch = max(1.0, length / new)
    centre = (at + 0.5) * length / new - 0.5
    w = _kernel(method, (old[None, :] - centre[:, None]) / stretch)
    return w / w.sum(1, keepdims=True)


def resample_tiles(tiles: DataFrame, scale: float, method: str = "cubic") -> DataFrame:
    """Scale blocks that carry their own halo: ``image, band, row_off, col_off, h, w, pixels``."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                h, w = max(1, round(r.h * scale)), max(1, round(r.w * scale))
                a = np.asarray(r.pixels, float).reshape(r.h, r.w)
                a = axis_weights(r.h, h, method) @ a @ axis_weights(r.w, w, method).T
                out.append((r.image, r.band, round(r.row_off * scale), round(r.col_off * scale), h, w, a.reshape(-1)))
            yield pd.DataFrame(out, columns=list(b.columns))

    cols = tiles.select("image", "band", "row_off", "col_off", "h", "w", F.col("pixels").cast("array<double>").alias("pixels"))
    return cols.mapInPandas(run, "image string, band int, row_off int, col_off int, h int, w int, pixels array<double>")


# ---------------------------------------------------------------- degradation


def rotated_mahalanobis(size: int, sx: float, sy: float, theta: float) -> np.ndarray:
    """Squared distance of each kernel cell from the centre, by a rotated covariance."""
    r = np.arange(size) - (size - 1) / 2
    x, y = np.meshgrid(r, r)
    c, s = math.cos(theta), math.sin(theta)
    u, v = c * x + s * y, -s * x + c * y
    return (u / sx) ** 2 + (v / sy) ** 2


def bessel_j1(x: np.ndarray) -> np.ndarray:
    """First-order Bessel function by its integral, (1/pi) int cos(t - x sin t) dt, as a midpoint sum."""
    t = (np.arange(256) + 0.5) * (math.pi / 256)
    return np.cos(t - np.asarray(x, float)[..., None] * np.sin(t)).mean(-1)


def blur_kernel(kind: str, size: int, sx: float = 1.0, sy: float = 1.0, theta: float = 0.0, beta: float = 1.0, mtf: float = 0.3) -> np.ndarray:
    """A normalised kernel: ``gaussian``, ``generalised``, ``plateau`` or ``sinc``.

    Beta is the power of the squared distance, so 1 gives the Gaussian.
    """
    if kind == "sinc":
        cut = math.pi * mtf
        r = np.arange(size) - (size - 1) / 2
        d = np.hypot(*np.meshgrid(r, r))
        k = np.where(d == 0, cut**2 / (4 * math.pi), cut * bessel_j1(cut * d) / (2 * math.pi * np.where(d == 0, 1, d)))
        k = np.maximum(k, 0)
    else:
        m = rotated_mahalanobis(size, sx, sy, theta)
        if kind == "gaussian":
            k = np.exp(-0.5 * m)
        elif kind == "generalised":
            k = np.exp(-0.5 * m**beta)
        elif kind == "plateau":
            k = 1 / (1 + m**beta)
        else:
            raise ValueError(f"unknown kernel: {kind}")
    if k.sum() < 1e-12:
        raise ValueError("the kernel has no weight")
    return k / k.sum()


def masked_blur(band: np.ndarray, valid: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Blur over valid pixels only: weighted values over weights, by Fourier transforms."""
    h, w = band.shape
    k = kernel.shape[0]
    shape = (h + k - 1, w + k - 1)
    spectrum = np.fft.rfft2(kernel, shape)
    lo = (k - 1) // 2

    def smooth(a: np.ndarray) -> np.ndarray:
        return np.fft.irfft2(np.fft.rfft2(a, shape) * spectrum, shape)[lo : lo + h, lo : lo + w]

    weight = smooth(valid.astype(float))
    value = smooth(np.where(valid, band, 0.0))
    return np.where(valid & (weight > 1e-8), value / np.maximum(weight, 1e-8), band)


#: Names of kernels and methods in the settings of a degradation, and the whole types of pixels.
KERNELS = {"gaussian": "gaussian", "generalized_gaussian": "generalised", "plateau": "plateau", "sinc_mtf": "sinc"}
SHRINKING = {"nearest": "nearest", "bilinear": "bilinear", "bicubic": "cubic", "area": "area"}
WHOLE_TYPES = {"uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767), "uint32": (0, 4294967295), "int32": (-2147483648, 2147483647)}


def pixel_range(dtype: str) -> tuple[float, float, bool]:
    """Least value, full scale, and whether pixels are whole, of a storage type; fractions are taken for shares of 1."""
    if dtype in WHOLE_TYPES:
        return (*map(float, WHOLE_TYPES[dtype]), True)
    if dtype.startswith("float"):
        return -math.inf, 1.0, False
    raise ValueError(f"unknown pixel type: {dtype}")


def sampled_kernel(rng: np.random.Generator, step: dict) -> np.ndarray:
    """A blur kernel of one kind, drawn by the kinds' weights; only what the kind needs is drawn, in a fixed order."""
    weights = step.get("blur_type_weights", {"gaussian": 1.0})
    share = np.array(list(weights.values()), float)
    name = list(weights)[int(rng.choice(len(weights), p=share / share.sum()))]
    if name not in KERNELS:
        raise ValueError(f"unknown blur type: {name}")
    size = int(rng.choice(step.get("kernel_sizes", [7])))
    draw = lambda key, lo, hi: float(rng.uniform(*step.get(key, (lo, hi))))
    sx, sy, theta = draw("sigma_x", 0.5, 2.0), draw("sigma_y", 0.5, 2.0), draw("theta_range", 0.0, math.pi)
    if name == "sinc_mtf":
        return blur_kernel("sinc", size, mtf=draw("mtf_nyquist_range", 0.2, 0.5))
    beta = draw("beta_range", 0.5, 2.0) if name != "gaussian" else 1.0
    return blur_kernel(KERNELS[name], size, sx, sy, theta, beta)


def noisy(bands: np.ndarray, valid: np.ndarray, rng: np.random.Generator, step: dict) -> np.ndarray:
    """Gaussian or Poisson noise on valid pixels; grey noise is the same in all bands, as drawn for the first."""
    fields = 1 if rng.random() < step.get("gray_prob", 0.4) else len(bands)
    if rng.random() < step.get("gaussian_prob", 0.5):
        noise = rng.normal(0, rng.uniform(*step.get("sigma_range", (0.005, 0.05))), (fields, *bands.shape[1:]))
    else:
        size = rng.uniform(*step.get("poisson_scale_range", (0.01, 0.1)))
        rate = np.clip(bands[:fields], 0, None)
        noise = (rng.poisson(rate) - rate) * size
    return np.where(valid, bands + noise, bands)


def degrade_tile(bands: np.ndarray, nodata: float | None, steps: list[dict], seed: int) -> np.ndarray:
    """Run blur, noise and resize steps over (bands, h, w) values in 0..1.

    Every step has its own generator, seeded from the tile's, so that steps can
    be left out without changing the others.
    """
    base = np.random.default_rng(seed)
    valid = np.ones(bands.shape, bool) if nodata is None else bands != nodata
    for i, step in enumerate(steps):
        rng = np.random.default_rng(int(base.integers(2**31)) + i)
        op = step["op"]
        if op in ("blur", "noise") and rng.random() > step.get("prob", 1.0):
            continue
        if op == "blur":
            kernel = sampled_kernel(rng, step)
            bands = np.stack([masked_blur(b, v, kernel) for b, v in zip(bands, valid, strict=True)])
        elif op == "noise":
            bands = noisy(bands, valid, rng, step)
        elif op == "resize":
            scale, methods = float(step.get("scale", 1.0)), list(step.get("methods", ["area", "bilinear", "bicubic"]))
            if abs(scale - 1) < 1e-6:
                continue
            if unknown := [m for m in methods if m not in SHRINKING]:
                raise ValueError(f"unknown methods: {', '.join(unknown)}")
            method = SHRINKING[str(rng.choice(methods))]
            h, w = (max(1, int(n / scale)) for n in bands.shape[1:])
            wy, wx = axis_weights(bands.shape[1], h, method), axis_weights(bands.shape[2], w, method)
            near = axis_weights(bands.shape[1], h, "nearest"), axis_weights(bands.shape[2], w, "nearest")
            bands = np.stack([wy @ b @ wx.T for b in bands])
            valid = np.stack([near[0] @ v @ near[1].T > 0.5 for v in valid.astype(float)])
        else:
            raise ValueError(f"unknown step: {op}")
    return bands


def spatial_scale(steps: list[dict]) -> float:
    """The product of all resize scales."""
    return math.prod(float(s.get("scale", 1.0)) for s in steps if s["op"] == "resize")


def degrade(tiles: DataFrame, steps: list[dict], seed: int = 0, top: float = 255.0, nodata: float | None = None) -> DataFrame:
    """Degrade halo tiles ``image, tile_no, n_bands, h, w, pixels`` (band after band).

    A tile's seed is made of the given one and its number, so results don't
    depend on how tiles are dealt to tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                a = np.asarray(r.pixels, float).reshape(r.n_bands, r.h, r.w) / top
                a = degrade_tile(a, None if nodata is None else nodata / top, steps, seed * 65537 + int(r.tile_no))
                out.append((r.image, r.tile_no, r.n_bands, a.shape[1], a.shape[2], np.clip(a * top, 0, top).reshape(-1)))
            yield pd.DataFrame(out, columns=list(b.columns))

    cols = tiles.select("image", "tile_no", "n_bands", "h", "w", F.col("pixels").cast("array<double>").alias("pixels"))
    return cols.mapInPandas(run, "image string, tile_no int, n_bands int, h int, w int, pixels array<double>")
