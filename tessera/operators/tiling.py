"""Tile grids, tile names and the projection of labels into tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import point, rectangle
from tessera.functions.overlap import visible_fraction

TILE_NAME = r"^(.*)_(\d+)_(\d+)$"


def _cells(length: Column, stride: int) -> Column:
    return F.sequence(F.lit(0), F.ceil(length / stride).cast("int") - 1)


def tile_grid(images: DataFrame, tile_size: int, overlap: int = 0) -> DataFrame:
    """One row for each tile of each image, from ``image, width, height``.

    Tiles start every ``tile_size - overlap`` pixels as long as they start
    inside; ``w, h`` is what the image fills of the tile.
    """
    if not 0 <= overlap < tile_size:
        raise ValueError("overlap must be at least 0 and below tile_size")
    stride = tile_size - overlap
    tiles = (
        images.where("width > 0 and height > 0")
        .withColumn("row", F.explode(_cells(F.col("height"), stride)))
        .withColumn("col", F.explode(_cells(F.col("width"), stride)))
    )
    x, y = F.col("col") * stride, F.col("row") * stride
    return tiles.withColumns({
        "x_off": x, "y_off": y, "w": F.least(F.lit(tile_size), F.col("width") - x), "h": F.least(F.lit(tile_size), F.col("height") - y),
        "tile": F.format_string("%s_%d_%d", F.col("image").cast("string"), x, y),
    })


def tile_count(width: Column, height: Column, stride: int) -> Column:
    return F.ceil(width / stride) * F.ceil(height / stride)


def halo_grid(images: DataFrame, tile_size: int, overlap: int) -> DataFrame:
    """Tiles with a core to write and a wider window to read."""
    stride = tile_size - overlap
    tiles = (
        images.where("width > 0 and height > 0")
        .withColumn("row", F.explode(_cells(F.col("height"), stride)))
        .withColumn("col", F.explode(_cells(F.col("width"), stride)))
    )
    out = tiles.withColumns({"core_x": F.col("col") * stride, "core_y": F.col("row") * stride})
    for axis, length, n in (("x", "width", "w"), ("y", "height", "h")):
        at = F.col(f"core_{axis}")
        core = F.least(F.lit(stride), F.col(length) - at)
        before = F.least(at, F.lit(overlap // 2))
        after = F.least(F.col(length) - at - core, F.lit(overlap) - before)
        out = out.withColumns({f"core_{n}": core, f"pad_before_{axis}": before, f"read_{axis}": at - before, f"read_{n}": core + before + after})
    return out


def output_window(tiles: DataFrame, scale: float) -> DataFrame:
    """Where a core lands after shrinking by ``scale``: edges rounded half to even, at least one pixel."""
    out = tiles
    for axis, n in (("x", "w"), ("y", "h")):
        lo = F.rint(F.col(f"core_{axis}") / scale)
        hi = F.rint((F.col(f"core_{axis}") + F.col(f"core_{n}")) / scale)
        out = out.withColumns({f"out_{axis}": lo.cast("int"), f"out_{n}": F.greatest(F.lit(1), (hi - lo).cast("int"))})
    return out


def halo_crop(tiles: DataFrame, scale: float) -> DataFrame:
    """Add ``crop_x, crop_y``: where the core begins in a read window that was shrunk by ``scale``.

    With ``out_w, out_h`` of ``output_window`` this is the part of it to write.
    """
    return tiles.withColumns({f"crop_{a}": F.rint((F.col(f"core_{a}") - F.col(f"read_{a}")) / scale).cast("int") for a in "xy"})


def parse_tile_names(tiles: DataFrame, name: str = "tile") -> DataFrame:
    """Add ``source_image, x_off, y_off``; names of another form are dropped."""
    part = lambda k: F.regexp_extract(F.col(name), TILE_NAME, k)
    return tiles.where(F.col(name).rlike(TILE_NAME)).withColumns(
        {"source_image": part(1), "x_off": part(2).try_cast("int"), "y_off": part(3).try_cast("int")}
    )


def project_labels(labels: DataFrame, tiles: DataFrame, tile_size: int, overlap: int = 0, min_visible: float = 0.1) -> DataFrame:
    """Image labels as tile labels: ``tile, image, line_no, class_id, corners, visible``.

    ``labels`` has shares of the image; corners come out as shares of the tile
    and are not clamped.  A label is dealt to the tiles that its bounds reach,
    found by arithmetic, so that the join is on tile indices; the exact visible
    share of its area in the whole tile square decides.  With ``min_visible`` 0
    every label goes to every tile of its image.
    """
    stride = tile_size - overlap
    grid = tiles.select("image", "row", "col", "x_off", "y_off", "tile", "width", "height")
    size = grid.select("image", "width", "height").distinct()
    px = labels.join(size, "image").withColumn(
        "ring", F.transform("corners", lambda p: point(p["x"] * F.col("width"), p["y"] * F.col("height")))
    )
    if min_visible > 0:
        xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
        # tile k spans [k * stride, k * stride + tile_size]
        first = lambda v: F.ceil((F.array_min(v) - tile_size) / stride).cast("int")
        last = lambda v: F.floor(F.array_max(v) / stride).cast("int")
        reach = lambda v: F.when(first(v) <= last(v), F.sequence(first(v), last(v)))
        px = px.withColumn("row", F.explode(reach(ys))).withColumn("col", F.explode(reach(xs)))
        pairs = px.drop("width", "height").join(grid.drop("width", "height"), ["image", "row", "col"])
    else:
        pairs = px.drop("width", "height").join(grid.drop("width", "height"), "image")
    x, y = F.col("x_off").cast("double"), F.col("y_off").cast("double")
    square = rectangle(x, y, x + tile_size, y + tile_size)
    shown = pairs.withColumn("visible", visible_fraction(F.col("ring"), square, 1e-9)).where(F.col("visible") >= min_visible)
    return shown.select(
        "tile", "image", "line_no", "class_id", F.transform("ring", lambda p: point((p["x"] - x) / tile_size, (p["y"] - y) / tile_size)).alias("corners"), "visible"
    )


def to_image_pixels(corners: Column, x_off: Column, y_off: Column, tile_size: int) -> Column:
    """Shares of a tile as pixels of its image."""
    return F.transform(corners, lambda p: point(p["x"] * tile_size + x_off, p["y"] * tile_size + y_off))


def tile_pixels(blocks: DataFrame, tiles: DataFrame, tile_size: int, fill: int = 0) -> DataFrame:
    """Padded tile rows from one-row blocks ``image, band, row_off, pixels``; uniform tiles are dropped.

    A block meets the tiles that contain its row; rows beyond the image are
    filled.  Minimum and maximum over all bands and rows of a padded tile tell
    whether it is uniform.
    """
    t = tiles.select("image", "tile", "x_off", "y_off", "w", "h").withColumn("row_off", F.explode(F.sequence("y_off", F.expr("y_off + h - 1"))))
    line = F.slice("pixels", F.col("x_off") + 1, F.col("w"))
    rows = blocks.join(t, ["image", "row_off"]).select(
        "image", "tile", "band", (F.col("row_off") - F.col("y_off")).alias("line"),
        F.concat(line, F.array_repeat(F.lit(fill), tile_size - F.col("w"))).alias("pixels"), (F.col("h") < tile_size).alias("__short"),
    )
    lo, hi = F.min(F.array_min("pixels")), F.max(F.array_max("pixels"))
    edge = F.max(F.col("__short").cast("int")) == 1
    with_fill = lambda v, f: F.when(edge, f(v, F.lit(fill))).otherwise(v)
    mixed = rows.groupBy("tile").agg(with_fill(lo, F.least).alias("lo"), with_fill(hi, F.greatest).alias("hi")).where("lo < hi").select("tile")
    return rows.drop("__short").join(mixed, "tile", "left_semi")


def tile_totals(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Tiles and labels by split and in all (split null)."""
    t = tiles.select("split", F.lit(1).alias("tiles"), F.lit(0).alias("labels"))
    n = labels.select("split", F.lit(0).alias("tiles"), F.lit(1).alias("labels"))
    return t.unionByName(n).rollup("split").agg(F.sum("tiles").alias("tiles"), F.sum("labels").alias("labels"))
