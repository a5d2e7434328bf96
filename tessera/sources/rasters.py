"""Raster tables: file listings, metadata and pixel blocks.

Pixels live in a Parquet table of blocks, apart from the metadata, so that
operators which need sizes and transforms alone never read a pixel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import files

META = (
    "image string, path string, width int, height int, n_bands int, dtype string, nodata double, crs string, "
    "affine struct<a:double,b:double,c:double,d:double,e:double,f:double>, tags map<string,string>"
)
BLOCKS = "image string, band int, row_off int, col_off int, h int, w int, pixels array<int>"
EXTENSIONS = ["*.tif", "*.TIF", "*.tiff", "*.TIFF"]


def list_files(spark: SparkSession, path: str, recursive: bool = False, pattern: str = "*.tif") -> DataFrame:
    """``path, length`` of the files, in path order; contents aren't read, and folders are walked by tasks.

    Files of no bytes are listed too, which Spark's readers leave out.  No file
    is an error.
    """
    found = files.listing(spark, path, EXTENSIONS if recursive else pattern, recursive).where("status <> 'missing'")
    if not found.take(1):
        raise FileNotFoundError(f"no {pattern} under {path}")
    return found.select("path", "length").orderBy("path")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META).parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def require_crs(meta: DataFrame) -> DataFrame:
    """The metadata; an image without a coordinate system is an error when it is read."""
    missing = F.raise_error(F.concat(F.lit("no coordinate system: "), "image")).cast("string")
    return meta.withColumn("crs", F.coalesce("crs", missing))


def tagged(meta: DataFrame, tags: dict[str, object]) -> DataFrame:
    """Add tags, which may be columns."""
    pairs = [c for k, v in tags.items() for c in (F.lit(k), v.cast("string") if hasattr(v, "cast") else F.lit(str(v)))]
    return meta.withColumn("tags", F.map_concat(F.coalesce("tags", F.create_map().cast("map<string,string>")), F.create_map(*pairs)))


def write_blocks(blocks: DataFrame, path: str, split: bool = False) -> None:
    """Parquet by image, and by split first where there is one, for pruning."""
    blocks.write.mode("overwrite").partitionBy(*(["split"] if split else []), "image").parquet(path)


def without_outputs(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Inputs whose output doesn't exist yet, by image."""
    return inputs.join(done.select("image").distinct(), "image", "left_anti")


def sidecars(images: DataFrame, files: DataFrame) -> DataFrame:
    """Each image's annotation file by its stem: ``.geojson`` before ``.json``, null if there is none."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    rank = F.when(F.lower(F.col("path")).endswith(".geojson"), 0).when(F.lower(F.col("path")).endswith(".json"), 1)
    best = (
        files.select(stem.alias("image"), F.struct(rank.alias("rank"), "path").alias("f")).where("f.rank is not null")
        .groupBy("image").agg(F.min("f").alias("f")).select("image", F.col("f.path").alias("sidecar"))
    )
    return images.join(best, "image", "left")
