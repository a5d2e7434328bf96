"""Annotation conversion: map polygons to normalised oriented-box labels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.crs import reproject_between
from tessera.functions.geometry import area, least_rectangle, least_sides, normalised, rectangle, to_pixels
from tessera.functions.overlap import visible_fraction
from tessera.functions.repair import repaired


@dataclass(frozen=True)
class AnnotationConfig:
    class_map: dict[int, int] = field(default_factory=dict)
    skip_classes: tuple[int, ...] = ()
    min_visible: float = 0.1
    min_side: float = 2.0
    annotation_crs: str = "EPSG:4326"


def remap_classes(rows: DataFrame, class_map: dict[int, int], skip: tuple[int, ...] = (), unknown: str = "drop") -> DataFrame:
    """Replace ``class_id``: skipped classes go first, then the map holds.

    A class outside the map is dropped, or stays as it is with ``unknown="keep"``.
    """
    if skip:
        rows = rows.where(~F.coalesce(F.col("class_id").isin(*skip), F.lit(False)))
    if not class_map:
        return rows if unknown == "keep" else rows.where(F.lit(False))
    known = F.create_map(*[F.lit(v) for kv in class_map.items() for v in kv])
    new = F.try_element_at(known, F.col("class_id"))
    if unknown == "keep":
        return rows.withColumn("class_id", F.coalesce(new, F.col("class_id")))
    return rows.withColumn("class_id", new).where("class_id is not null")


def remap_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files and label lines that a remap went through."""
    return before.agg(F.countDistinct("image").alias("files")).crossJoin(after.agg(F.count("*").alias("annotations")))


def convert(annotations: DataFrame, images: DataFrame, cfg: AnnotationConfig) -> DataFrame:
    """``image, ordinal, class_id, corners``: labels of all images.

    The order is fixed: classes, repair of the ring, rectangle in the annotation's own system,
    reprojection, visible share in the image, pixels, least side, normalising,
    and last the test for boxes that clamping left without area.  ``images`` has
    ``image, width, height, crs, affine`` and is joined by name; every image may
    have a system of its own.
    """
    rows = remap_classes(annotations.withColumn("class_id", F.coalesce("class_id", F.lit(-1))), cfg.class_map, cfg.skip_classes)
    rows = rows.withColumn("box", least_rectangle(repaired(F.col("ring")))).where("box is not null")
    joined = rows.join(images.select("image", "width", "height", "crs", "affine"), "image")
    world = reproject_between(F.col("box"), F.lit(cfg.annotation_crs), F.col("crs"))
    px = joined.withColumn("px", to_pixels(world, F.col("affine"))).where("px is not null")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    seen = px.withColumn("__seen", visible_fraction(F.col("px"), rectangle(F.lit(0.0), F.lit(0.0), w, h))).where(F.col("__seen") >= cfg.min_visible)
    out = seen.withColumn("corners", normalised(least_sides(F.col("px"), cfg.min_side), w, h))
    return out.where(area(F.col("corners")) >= 1e-12).select("image", "ordinal", "class_id", "corners")


def size_summary(labels: DataFrame) -> DataFrame:
    """Mean sides in pixels, area and aspect ratio of each class, from ``class_id, ring``."""
    side = lambda i, j: F.hypot(F.col("ring")[j]["x"] - F.col("ring")[i]["x"], F.col("ring")[j]["y"] - F.col("ring")[i]["y"])
    s = labels.withColumns({"__a": side(0, 1), "__b": side(0, 3)})
    s = s.withColumns({"__long": F.greatest("__a", "__b"), "__short": F.least("__a", "__b")})
    return s.groupBy("class_id").agg(
        F.count("*").alias("n"), F.avg("__long").alias("long_side"), F.avg("__short").alias("short_side"),
        F.avg(F.col("__a") * F.col("__b")).alias("area"), F.avg(F.when(F.col("__short") > 0, F.col("__long") / F.col("__short"))).alias("aspect"),
    )
