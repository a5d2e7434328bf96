"""Experiment grids: runs, their shared stages, the step plan and run outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the shipped grid.
UPSCALES = (1.0, 2.0, 4.0)
TILES = (640, 1024, 1536)
CLASS_COUNTS = (6, 4)
ARCHITECTURES = ("std", "p2")
OUT_OF_MEMORY = "(?i)cuda out of memory|outofmemoryerror|cuda error: out of memory"


def _text(scale: Column) -> Column:
    """A scale without a needless point: 1.0 is ``1``."""
    return F.when(scale == F.floor(scale), F.floor(scale).cast("string")).otherwise(scale.cast("string"))


def runs(
    spark: SparkSession,
    upscales: tuple[float, ...] = UPSCALES,
    tiles: tuple[int, ...] = TILES,
    class_counts: tuple[int, ...] = CLASS_COUNTS,
    architectures: tuple[str, ...] = ARCHITECTURES,
) -> DataFrame:
    """All runs in order of scale, tile, classes and architecture, with the keys of the stages they share."""
    one = spark.range(1).drop("id")
    for name, values in (("upscale_ratio", upscales), ("tile_size", tiles), ("n_classes", class_counts), ("arch_id", architectures)):
        one = one.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"__{name}", name))
    order = [F.col(f"__{n}") for n in ("upscale_ratio", "tile_size", "n_classes", "arch_id")]
    up = F.concat(F.lit("up"), _text(F.col("upscale_ratio")))
    cl = F.concat(F.lit("cl"), F.col("n_classes").cast("string"))
    t = F.concat(F.lit("t"), F.col("tile_size").cast("string"))
    keyed = one.withColumns({
        "preproc_key": F.concat_ws("_", up, cl), "tiling_key": F.concat_ws("_", up, t, cl), "run_id": F.concat_ws("_", up, t, cl, "arch_id")
    })
    ordinal = F.row_number().over(Window.orderBy(*order)) - 1
    return keyed.select(ordinal.alias("ordinal"), "run_id", "upscale_ratio", "tile_size", "n_classes", "arch_id", "preproc_key", "tiling_key")


def steps(grid: DataFrame) -> DataFrame:
    """``index, stage, key``: every shared stage once, in order of first use, then all trainings."""
    stage = lambda k, name, key: grid.groupBy(F.col(key).alias("key")).agg(F.min("ordinal").alias("first")).select(F.lit(k).alias("k"), F.lit(name).alias("stage"), "key", "first")
    all_ = stage(0, "preproc", "preproc_key").unionByName(stage(1, "tiling", "tiling_key")).unionByName(stage(2, "train", "run_id"))
    index = F.row_number().over(Window.orderBy("k", "first")) - 1
    return all_.select(index.alias("index"), "stage", "key")


def outcomes(grid: DataFrame, failed: DataFrame) -> DataFrame:
    """``run_id, status, failed_stage`` from failed stages ``stage, key, oom``.

    A stage runs once; whoever shares it inherits its failure.  The earliest
    failed stage of a run counts.
    """
    hit = lambda stage, key: failed.where(F.col("stage") == stage).select(F.col("key").alias(key), F.col("oom").alias(f"{stage}_oom"))
    j = grid.join(hit("preproc", "preproc_key"), "preproc_key", "left").join(hit("tiling", "tiling_key"), "tiling_key", "left").join(hit("train", "run_id"), "run_id", "left")
    names = ("preproc", "tiling", "train")
    stage = F.coalesce(*[F.when(F.col(f"{s}_oom").isNotNull(), F.lit(s)) for s in names])
    oom = F.coalesce(*[F.col(f"{s}_oom") for s in names])
    status = F.when(stage.isNull(), "success").when(oom, "oom").otherwise("failed")
    return j.select("ordinal", "run_id", status.alias("status"), stage.alias("failed_stage"))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("runs"))


def is_out_of_memory(log: Column) -> Column:
    return F.coalesce(log.rlike(OUT_OF_MEMORY), F.lit(False))
