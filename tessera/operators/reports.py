"""Small results as files and text: metric tables, data set descriptions, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.crs import reproject
from tessera.functions.geometry import to_world
from tessera.operators.tiling import to_image_pixels
from tessera.sources.files import write_text_files


def write_csv(table: DataFrame, path: str) -> None:
    """One CSV file with a header; for tables of a few rows, such as metrics and sweeps."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_summary(spark, path: str) -> DataFrame:
    """A published summary: text and numbers come with stray blanks."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    text = {"Image", "Class"}
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) if c.strip() in text else F.trim(F.col(f"`{c}`")).try_cast("double").alias(c.strip()) for c in raw.columns])


def dataset_description(root: str, names: dict[int, str], tiling_key: str) -> dict:
    """What a trainer needs to find the tiles; classes are numbered from 0."""
    if sorted(names) != list(range(len(names))):
        raise ValueError("classes must be numbered from 0 without gaps")
    return {
        "path": root, "train": "images/train", "val": "images/val", "test": "images/test", "nc": len(names),
        "names": [names[i] for i in range(len(names))], "tiling_key": tiling_key,
    }


def write_dataset(spark, root: str, names: dict[int, str], tiling_key: str, name: str = "dataset.yaml") -> None:
    """``dataset_description`` as a YAML file below ``root``, published when it is whole."""
    import yaml

    text = yaml.safe_dump(dataset_description(root, names, tiling_key), sort_keys=False, allow_unicode=True)
    write_text_files(spark.createDataFrame([(name, text)], "name string, value string"), root)


def run_summary(results: DataFrame) -> DataFrame:
    """A line for each run, in order: status, name, and the failed stage if there is one."""
    where = F.when(F.col("failed_stage").isNotNull(), F.concat(F.lit(" at "), "failed_stage")).otherwise("")
    return results.orderBy("ordinal").select(F.concat(F.rpad("status", 8, " "), "run_id", where).alias("line"))


def shared_systems(truths: DataFrame, detections: DataFrame) -> DataFrame:
    """Coordinate systems that both sides have; an empty result means nothing can match."""
    return truths.select("crs").intersect(detections.select("crs"))


def tile_to_wgs84(corners: Column, x_off: Column, y_off: Column, tile_size: int, affine: Column, crs: str) -> Column:
    """Shares of a tile as longitude and latitude."""
    return reproject(to_world(to_image_pixels(corners, x_off, y_off, tile_size), affine), crs, "EPSG:4326")


def image_to_wgs84(corners: Column, width: Column, height: Column, affine: Column, crs: str) -> Column:
    """Shares of an image as longitude and latitude."""
    px = F.transform(corners, lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y")))
    return reproject(to_world(px, affine), crs, "EPSG:4326")
