"""Windows over images that are stored as blocks: gathering, scaling, halo tiles.

A window rarely is a block.  It asks for the blocks it touches by their place in
the image's grid of blocks, an equi-join; each of these sends the strip that
lies in the window, cut out in Catalyst, and the strips of a window are put
together.  So a block's neighbours send it only their borders, and what one
task holds is a window.

Blocks are ``image, band, row_off, col_off, h, w, pixels``; all but an image's
last row and column of blocks have one size, which is read from the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import raster, tiling

STRIPS = "array<struct<band:int,top:int,left:int,h:int,w:int,pixels:array<double>>>"
#: How far the kernels reach, in pixels of the coarser of both images.
REACH = {"nearest": 0.5, "bilinear": 1.0, "cubic": 2.0, "lanczos": 3.0}


def _placed(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with their place ``__r, __c`` in the grid, and ``__bh, __bw`` of each image."""
    sizes = blocks.groupBy("image").agg(F.max("h").alias("__bh"), F.max("w").alias("__bw"))
    at = blocks.join(sizes, "image")
    ragged = F.raise_error(F.format_string("block at %d, %d is not on the grid of its image", "row_off", "col_off")).cast("int")
    on_grid = (F.col("row_off") % F.col("__bh") == 0) & (F.col("col_off") % F.col("__bw") == 0)
    row = F.when(on_grid, (F.col("row_off") / F.col("__bh")).cast("int")).otherwise(ragged)
    return at.withColumns({"__r": row, "__c": (F.col("col_off") / F.col("__bw")).cast("int")}).drop("__bh", "__bw"), sizes


def gather(blocks: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows`` with ``strips``: the parts of all bands of the blocks that each window ``y, x, height, width`` touches.

    ``windows`` has ``image, window`` (a name or number, unique in its image)
    and any further columns.  A window that touches no block is left out.
    """
    at, sizes = _placed(blocks)
    span = lambda lo, n, side: F.explode(F.sequence((F.col(lo) / F.col(side)).cast("int"), ((F.col(lo) + F.col(n) - 1) / F.col(side)).cast("int")))
    asked = windows.where("height > 0 and width > 0").select("image", "window", "y", "x", "height", "width").join(sizes, "image")
    asked = asked.withColumn("__r", span("y", "height", "__bh")).withColumn("__c", span("x", "width", "__bw")).drop("__bh", "__bw")
    met = asked.join(at, ["image", "__r", "__c"])
    top, left = F.greatest("y", "row_off"), F.greatest("x", "col_off")
    h = F.least(F.col("y") + F.col("height"), F.col("row_off") + F.col("h")) - top
    w = F.least(F.col("x") + F.col("width"), F.col("col_off") + F.col("w")) - left
    met = met.withColumns({"__top": top, "__left": left, "__h": h, "__w": w}).where("__h > 0 and __w > 0")
    line = lambda r: F.slice("pixels", (r - F.col("row_off")) * F.col("w") + F.col("__left") - F.col("col_off") + 1, F.col("__w"))
    whole = (F.col("__h") == F.col("h")) & (F.col("__w") == F.col("w"))
    part = F.when(whole, F.col("pixels")).otherwise(F.flatten(F.transform(F.sequence(F.col("__top"), F.col("__top") + F.col("__h") - 1), line)))
    strip = F.struct(
        F.col("band").cast("int").alias("band"), (F.col("__top") - F.col("y")).cast("int").alias("top"), (F.col("__left") - F.col("x")).cast("int").alias("left"),
        F.col("__h").cast("int").alias("h"), F.col("__w").cast("int").alias("w"), part.cast("array<double>").alias("pixels"),
    )
    strips = met.select("image", "window", strip.alias("s")).groupBy("image", "window").agg(F.collect_list("s").cast(STRIPS).alias("strips"))
    return windows.join(strips, ["image", "window"])


def assembled(strips: list[dict], height: int, width: int, fill: float = np.nan) -> dict[int, np.ndarray]:
    """The bands of a window; what no block covers is ``fill``."""
    out: dict[int, np.ndarray] = {}
    for s in strips:
        band = out.setdefault(s["band"], np.full((height, width), fill))
        band[s["top"] : s["top"] + s["h"], s["left"] : s["left"] + s["w"]] = np.reshape(s["pixels"], (s["h"], s["w"]))
    return dict(sorted(out.items()))


def strip_rows(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[dict]]]:
    """Rows of a batch, each with its strips; pixels stay numpy arrays."""
    lists = batch.column("strips")
    at = np.asarray(lists.offsets)
    flat = lists.values
    fields = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("band", "top", "left", "h", "w")}
    pixels = flat.field("pixels")
    starts = np.asarray(pixels.offsets)
    values = pixels.values.to_numpy(zero_copy_only=False)
    rest = batch.drop_columns(["strips"]).to_pylist()
    for i, row in enumerate(rest):
        yield row, [{**{k: int(v[j]) for k, v in fields.items()}, "pixels": values[starts[j] : starts[j + 1]]} for j in range(at[i], at[i + 1])]


# ------------------------------------------------------------------- scaling


def _needed(length: str, new: str, start: Column, n: Column, method: str) -> dict[str, Column]:
    """What a block's part of the new image begins and ends with, and the old pixels that it is made of."""
    scale = F.col(new) / F.col(length)
    first, last = F.rint(start * scale).cast("int"), F.rint((start + n) * scale).cast("int")
    centre = lambda o: (o + 0.5) / scale - 0.5
    reach = REACH[method] * F.greatest(F.lit(1.0), 1 / scale)
    lo = F.greatest(F.lit(0), F.floor(centre(first) - reach)).cast("int")
    hi = F.least(F.col(length), F.ceil(centre(last - 1) + reach) + 1).cast("int")
    return {"first": first, "n": last - first, "lo": lo, "old": hi - lo}


def resample(blocks: DataFrame, images: DataFrame, scale: float, method: str = "cubic") -> DataFrame:
    """Scale images of any number of blocks: the same pixels as if each image were one block.

    ``images`` has ``image, width, height``.  A block becomes the part of the new
    image between its rounded edges, so parts neither overlap nor leave gaps,
    made of its pixels and its neighbours' as far as the kernel reaches.  A
    block that shrinks to nothing gives no row.
    """
    if method not in raster.METHODS:
        raise ValueError(f"unknown method: {method}")
    meta = raster.scaled_meta(images.select("image", "width", "height"), scale).select("image", "width", "height", "new_width", "new_height")
    own = blocks.select("image", "row_off", "col_off", "h", "w").distinct().join(meta, "image")
    y, x = _needed("height", "new_height", F.col("row_off"), F.col("h"), method), _needed("width", "new_width", F.col("col_off"), F.col("w"), method)
    windows = own.select(
        "image", F.format_string("%d_%d", "row_off", "col_off").alias("window"), F.col("width").alias("image_w"), F.col("height").alias("image_h"), "new_width", "new_height",
        y["lo"].alias("y"), x["lo"].alias("x"), y["old"].alias("height"), x["old"].alias("width"),
        y["first"].alias("out_y"), x["first"].alias("out_x"), y["n"].alias("out_h"), x["n"].alias("out_w"),
    ).where("out_h > 0 and out_w > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r, strips in strip_rows(b):
                wy = raster.axis_weights(r["image_h"], r["new_height"], method, slice(r["out_y"], r["out_y"] + r["out_h"]), slice(r["y"], r["y"] + r["height"]))
                wx = raster.axis_weights(r["image_w"], r["new_width"], method, slice(r["out_x"], r["out_x"] + r["out_w"]), slice(r["x"], r["x"] + r["width"]))
                for band, a in assembled(strips, r["height"], r["width"]).items():
                    out.append((r["image"], band, r["out_y"], r["out_x"], r["out_h"], r["out_w"], (wy @ a @ wx.T).reshape(-1)))
            yield _batch(out, b.schema.field("image").type)

    kind = dict(blocks.dtypes)["image"]
    return gather(blocks, windows).mapInArrow(run, f"image {kind}, band int, row_off int, col_off int, h int, w int, pixels array<double>")


def _batch(rows: list[tuple], image: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    types = [image, *[pa.int32()] * 5, pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["image", "band", "row_off", "col_off", "h", "w", "pixels"])


# ------------------------------------------------------------ tiles of pixels


def tile_windows(tiles: DataFrame, tile_size: int) -> DataFrame:
    """Tiles of ``tiling.tile_grid`` as windows."""
    return tiles.select("image", F.col("tile").alias("window"), F.col("y_off").alias("y"), F.col("x_off").alias("x"), F.col("h").alias("height"), F.col("w").alias("width"))


def cut_tiles(blocks: DataFrame, tiles: DataFrame, tile_size: int, fill: float = 0.0, keep_uniform: bool = False) -> DataFrame:
    """Pixels of square tiles from blocks of any size: ``image, tile, band, row_off, col_off, h, w, pixels``.

    What lies beyond the image is ``fill``; tiles that are one value throughout
    are left out unless ``keep_uniform``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, names = [], []
            for r, strips in strip_rows(b):
                bands = assembled(strips, tile_size, tile_size, fill)
                if keep_uniform or len({float(e) for a in bands.values() for e in (a.min(), a.max())}) > 1:
                    rows += [(r["image"], band, r["y"], r["x"], tile_size, tile_size, a.reshape(-1)) for band, a in bands.items()]
                    names += [r["window"]] * len(bands)
            yield _batch(rows, b.schema.field("image").type).append_column("tile", pa.array(names, pa.string()))

    kind = dict(blocks.dtypes)["image"]
    schema = f"image {kind}, band int, row_off int, col_off int, h int, w int, pixels array<double>, tile string"
    return gather(blocks, tile_windows(tiles, tile_size)).mapInArrow(run, schema)


# ---------------------------------------------------------------- degradation


def degrade_images(blocks: DataFrame, images: DataFrame, steps: list[dict], tile_size: int, overlap: int, seed: int = 0) -> DataFrame:
    """Degrade whole images: halo tiles are gathered, degraded, and their cores put out as blocks of the new image.

    ``images`` has ``image, width, height, dtype`` and may have ``nodata``; the
    storage type tells what counts as full scale; whole types saturate and drop
    fractions (``raster.pixel_range``).  The new size is the old one over the product of
    all scales, and cores lie between rounded edges.
    """
    scale = raster.spatial_scale(steps)
    names = [c for c in ("nodata",) if c in images.columns]
    grid = tiling.halo_crop(tiling.output_window(tiling.halo_grid(images.select("image", "width", "height", "dtype", *names), tile_size, overlap), scale), scale)
    number = F.row_number().over(Window.partitionBy("image").orderBy("core_y", "core_x")) - 1
    windows = grid.select(
        "image", F.format_string("%d_%d", "core_y", "core_x").alias("window"), F.col("read_y").alias("y"), F.col("read_x").alias("x"), F.col("read_h").alias("height"),
        F.col("read_w").alias("width"), "out_y", "out_x", "out_h", "out_w", "crop_y", "crop_x", "dtype", *names, number.alias("number"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r, strips in strip_rows(b):
                bands = assembled(strips, r["height"], r["width"], 0.0)
                lo, top, whole = raster.pixel_range(r["dtype"])
                nodata = r.get("nodata")
                a = raster.degrade_tile(np.stack(list(bands.values())) / top, None if nodata is None else nodata / top, steps, seed * 65537 + r["number"])
                a = np.trunc(np.clip(a * top, lo, top)) if whole else a * top
                # a shrunk window may end a pixel early; its last row and column go on then
                rows = np.minimum(r["crop_y"] + np.arange(r["out_h"]), a.shape[1] - 1)
                cols = np.minimum(r["crop_x"] + np.arange(r["out_w"]), a.shape[2] - 1)
                for band, v in zip(bands, a[:, rows][:, :, cols], strict=True):
                    out.append((r["image"], band, r["out_y"], r["out_x"], r["out_h"], r["out_w"], v.reshape(-1)))
            yield _batch(out, b.schema.field("image").type)

    kind = dict(blocks.dtypes)["image"]
    return gather(blocks, windows).mapInArrow(run, f"image {kind}, band int, row_off int, col_off int, h int, w int, pixels array<double>")

