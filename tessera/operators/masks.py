"""Mask filters: keep or drop boxes by the share of their area inside masks.

``masks`` has ``image, kind, polygon_id, ring_id, ring``; ring 0 is a polygon's
outline, others are holes.  Polygons of an image may overlap: what several of
them cover counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.crs import reproject_between
from tessera.functions.geometry import RING, area, bounds
from tessera.functions.overlap import Rings, overlap_area, shared_area
from tessera.operators import keyed
from tessera.operators.dissolve import CELL_EDGES, dissolve, pieces_of
from tessera.operators.meeting import meeting

TINY = 1e-12


def covered(boxes: DataFrame, masks: DataFrame, cell: float | None = None, small: int | None = None) -> DataFrame:
    """Add ``fraction``, the share of each box inside its image's masks, and ``has_mask``.

    Masks are dissolved first, so what a box shares with their pieces adds up.
    Images of few boxes and mask edges are worked out where one shuffle brings
    them together.  For others, and with a ``cell``, boxes and pieces meet by
    grid cells, so a box is only clipped by pieces that come near.
    """
    if cell is not None:
        return _covered_large(boxes, masks, cell)
    rings = masks.select("image", F.col("kind").alias("__kind"), "ring_id", F.col("ring").cast(RING).alias("__ring"))
    counts = boxes.select("image", F.lit(0).alias("n")).unionByName(masks.select("image", F.size("ring").alias("n")))
    is_large = (F.count_if(F.col("n") == 0) > (keyed.SMALL_KEY if small is None else small)) | (F.sum("n") > CELL_EDGES)
    large = keyed.large_keys(counts, ["image"], is_large)
    (few, many), (few_rings, _) = (keyed.apart(df, large, ["image"]) for df in (boxes, rings))
    few = few.withColumn("ring", F.col("ring").cast(RING))
    rows = few.withColumn("__box", F.lit(True)).unionByName(few_rings.withColumnRenamed("ring_id", "__ring_id").withColumn("__box", F.lit(False)), allowMissingColumns=True)
    columns = few.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in keyed.whole(batches, ["image"]):
            box = keyed.flat(t.column("__box")).to_numpy(zero_copy_only=False).astype(bool)
            b, m = t.filter(pa.array(box)), t.filter(pa.array(~box))
            fraction, known = _shares(b, group[box], m, group[~box])
            out = b.select(columns).append_column("fraction", fraction).append_column("has_mask", pa.array(known))
            yield from out.combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema) + ", fraction double, has_mask boolean"
    out = keyed.together(rows, ["image"]).mapInArrow(run, schema)
    if many is None:
        return out
    return out.unionByName(_covered_large(many, masks.join(F.broadcast(large), "image", "left_semi"), None))


def _shares(boxes: pa.Table, image: np.ndarray, masks: pa.Table, mask_image: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """``fraction`` and ``has_mask`` of the boxes of whole images."""
    ring = keyed.flat(boxes.column("ring"))
    own = np.zeros(len(boxes))
    for k in range(0, len(own), keyed.PAIRS):
        own[k : k + keyed.PAIRS] = np.abs(Rings.of(ring.slice(k, keyed.PAIRS)).signed_area())
    inside = np.zeros(len(own))
    # masks of an image are dissolved by kind, which has no null
    kinds = np.unique(np.asarray(keyed.flat(masks.column("__kind")).to_pylist(), object).astype(str), return_inverse=True)[1] if len(masks) else np.zeros(0, int)
    named = ~np.asarray(keyed.flat(masks.column("__kind")).is_null())
    span = int(kinds.max(initial=0)) + 1
    rings, ids = (keyed.flat(masks.column(c)).filter(pa.array(named)) for c in ("__ring", "__ring_id"))
    bounds_ = keyed.ring_bounds(ring)
    for mask, _, _, piece in pieces_of((mask_image * span + kinds)[named], rings, ids):
        both = tuple(np.concatenate(v) for v in zip(bounds_, keyed.ring_bounds(piece), strict=True))
        side = np.arange(len(both[0])) >= len(own)
        i, j = keyed.gathered(keyed.touching(np.concatenate([image, mask // span]), both, side))
        i, j = np.where(side[i], j, i), np.where(side[i], i, j) - len(own)
        np.add.at(inside, i, keyed.measured(shared_area, ring, piece, i, j))
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.minimum(1.0, inside / own)
    return pa.array(share, mask=own < TINY), np.isin(image, mask_image)


def _covered_large(boxes: DataFrame, masks: DataFrame, cell: float | None) -> DataFrame:
    b = boxes.select("image", "ordinal", "ring", bounds(F.col("ring")).alias("__b"))
    pieces = dissolve(masks, cell).select("image", F.col("ring").alias("__piece"), bounds(F.col("ring")).alias("__m"))
    met = meeting(b, pieces, ["image"], "__b", "__m").withColumn("__shared", overlap_area(F.col("ring"), F.col("__piece")))
    sums = met.groupBy("image", "ordinal").agg(F.sum("__shared").alias("__in"))
    known = masks.select("image").distinct().withColumn("has_mask", F.lit(True))
    out = boxes.join(sums, ["image", "ordinal"], "left").join(known, "image", "left")
    out = out.withColumn("__all", area(F.col("ring")))
    share = F.least(F.lit(1.0), F.coalesce("__in", F.lit(0.0)) / F.col("__all"))
    return out.withColumns(
        {"fraction": F.when(F.col("__all") >= TINY, share), "has_mask": F.coalesce("has_mask", F.lit(False))}
    ).drop("__in", "__all")


def masks_in(masks: DataFrame, images: DataFrame, crs: str = "EPSG:4326") -> DataFrame:
    """Masks of one system in the systems of their images, ``image, crs``; images without one leave their masks out."""
    to = masks.join(images.select("image", F.col("crs").alias("__crs")).where("crs is not null"), "image")
    return to.withColumn("ring", reproject_between(F.col("ring"), F.lit(crs), F.col("__crs"))).drop("__crs")


def mask_filter(boxes: DataFrame, masks: DataFrame, threshold: float, criterion: str, tiny_stays: bool = True) -> DataFrame:
    """Filter by the covered share: ``area_inside`` keeps shares of at least the threshold, ``area_overlap`` those below.

    Images without a mask pass through.  Boxes with hardly any area stay, or
    fall if ``tiny_stays`` is false.
    """
    if criterion not in ("area_inside", "area_overlap"):
        raise ValueError(f"unknown criterion: {criterion}")
    c = covered(boxes, masks)
    fits = F.col("fraction") >= threshold if criterion == "area_inside" else F.col("fraction") < threshold
    keep = ~F.col("has_mask") | F.coalesce(fits, F.lit(tiny_stays))
    return c.where(keep).select(*boxes.columns)


def coastline_filter(boxes: DataFrame, masks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Keep boxes that lie inside the operational area."""
    return mask_filter(boxes, masks.where("kind = 'coastline'"), threshold, "area_inside")


def buildings_filter(boxes: DataFrame, masks: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Drop boxes that lie on buildings."""
    return mask_filter(boxes, masks.where("kind = 'buildings'"), threshold, "area_overlap")


def removed_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows removed for each image, and in all (image null)."""
    a = before.select("image", F.lit(1).alias("n")).unionByName(after.select("image", F.lit(-1).alias("n")))
    return a.rollup("image").agg(F.sum("n").alias("removed"))
