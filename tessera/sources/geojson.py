"""GeoJSON feature collections as rows, and rows as feature collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.geometry import RING, area, point
from tessera.functions.repair import repair_masks, repaired
from tessera.sources.files import listing, write_text_files

PROPERTIES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("label", "class_name", "source_tile", "source_image")]
    + [T.StructField(n, T.IntegerType()) for n in ("class_id", "ground_truth")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("deleted", T.BooleanType())]
)
GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])
FEATURE = T.StructType([T.StructField("type", T.StringType()), T.StructField("properties", PROPERTIES), T.StructField("geometry", GEOMETRY)])
COLLECTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.LongType())),
    T.StructField("features", T.ArrayType(FEATURE)),
])


#: Masks: coordinates as text, since their depth depends on the geometry's type.
MASKS = "features array<struct<geometry: struct<type: string, coordinates: string>>>"


def stem(path: Column) -> Column:
    """File name without folders and the last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def read_features(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """One row for each feature of each file: ``image, ordinal, properties..., ring``.

    ``ring`` is a polygon's outline without the closing point, null where there
    is no geometry.  A file without features gives no row, and of a list of
    paths those that are missing are skipped (``files.listing`` names them).
    """
    if not isinstance(path, str):
        path = [r["path"] for r in listing(spark, path).where("status <> 'missing'").select("path").collect()]
        if not path:
            return spark.createDataFrame([], T.StructType([T.StructField("image", T.StringType()), T.StructField("ordinal", T.IntegerType()), *PROPERTIES.fields, T.StructField("ring", T._parse_datatype_string(RING))]))
    df = spark.read.schema(COLLECTION).option("multiLine", True).option("recursiveFileLookup", recursive).json(path)
    rows = df.select(stem(F.input_file_name()).alias("image"), F.posexplode("features").alias("ordinal", "f"))
    return rows.select("image", "ordinal", "f.properties.*", open_ring(F.col("f.geometry.coordinates")[0]).alias("ring"))


def open_ring(coordinates: Column) -> Column:
    r = F.transform(coordinates, lambda p: point(p[0], p[1]))
    closed = (F.size(r) > 1) & (r[0] == F.element_at(r, -1))
    return F.when(closed, F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r).cast(RING)


def valid_detections(features: DataFrame, names: dict[int, str] | None = None, truth: bool = False) -> DataFrame:
    """Features that are usable detections: a class and a polygon of some area.

    A ring that crosses or touches itself is repaired, and only goes if it
    encloses nothing.  Ground truth has no confidence, whatever the file says.
    A class without a name goes by its number.
    """
    name = F.col("class_id").cast("string")
    if names:
        name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), F.col("class_id")), name)
    usable = features.where(F.col("class_id").isNotNull()).withColumn("ring", repaired(F.col("ring")))
    out = usable.where((F.size("ring") >= 3) & (area(F.col("ring")) > 0)).withColumn("class_name", name)
    return out.withColumn("confidence", F.lit(None).cast("double")) if truth else out


def polygons(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """Mask rings ``image, kind, polygon_id, ring_id, ring`` of all Polygon and MultiPolygon features of the files, repaired.

    A file of which no polygon is left is an error when its rows are read: it
    would otherwise pass for an image without a mask.
    """
    df = spark.read.schema(MASKS).option("multiLine", True).json(path)
    parsed = lambda f, depth: F.from_json(f["geometry"]["coordinates"], "array<" * depth + "double" + ">" * depth)
    parts = F.transform("features", lambda f: F.when(f["geometry"]["type"] == "MultiPolygon", parsed(f, 4)).when(f["geometry"]["type"] == "Polygon", F.array(parsed(f, 3))))
    rows = df.select(stem(F.input_file_name()).alias("image"), F.posexplode_outer(F.flatten(F.filter(parts, lambda p: p.isNotNull()))).alias("polygon_id", "p"))
    rings = rows.select("image", F.lit(kind).alias("kind"), "polygon_id", F.posexplode_outer("p").alias("ring_id", "c"))
    found = repair_masks(rings.select("image", "kind", "polygon_id", "ring_id", open_ring(F.col("c")).alias("ring")))
    some = found.select("image").distinct().withColumn("__some", F.lit(True))
    bare = rows.select("image").distinct().join(some, "image", "left_anti")
    stop = F.raise_error(F.concat(F.lit("no usable polygon in the mask of "), F.col("image")))
    return found.unionByName(bare.select(stop.cast("string").alias("image"), F.lit(kind).alias("kind"), F.lit(0).alias("polygon_id"), F.lit(0).alias("ring_id"), F.array().cast(RING).alias("ring")))


def closed_coordinates(ring: Column) -> Column:
    pair = lambda p: F.array(p["x"], p["y"])
    return F.array(F.concat(F.transform(ring, pair), F.array(pair(ring[0]))))


def feature_json(evaluation: bool = False) -> Column:
    """A row's feature as JSON text: 4 decimals of confidence, null kept; an absent source tile is left out."""
    confidence = F.round("confidence", 4).alias("confidence")
    base = ["label", "class_id", "class_name", confidence]
    if evaluation:
        base += ["ground_truth", "deleted"]
    geometry = F.struct(F.lit("Polygon").alias("type"), closed_coordinates(F.col("ring")).alias("coordinates")).alias("geometry")
    kept = {"ignoreNullFields": "false"}

    def text(*tile: str) -> Column:
        properties = F.struct(*base, *tile, F.col("image").alias("source_image")).alias("properties")
        return F.to_json(F.struct(F.lit("Feature").alias("type"), properties, geometry), kept)

    if evaluation:
        return text()
    return F.when(F.col("source_tile").isNull(), text()).otherwise(text("source_tile"))


def label_rank(label: Column) -> Column:
    """TP before FP before FN before all others."""
    return F.when(label == "TP", 0).when(label == "FP", 1).when(label == "FN", 2).otherwise(9)


def collections(rows: DataFrame, evaluation: bool = False) -> DataFrame:
    """``image, value``: one feature collection for each image, with counts as metadata.

    Predictions go by label, then ordinal; evaluation rows by branch, then
    ordinal, and deleted ones don't count as TP or FP.
    """
    order = F.struct(F.col("branch") if evaluation else label_rank(F.col("label")), "ordinal", feature_json(evaluation).alias("json"))
    live = ~F.coalesce(F.col("deleted"), F.lit(False)) if evaluation else F.lit(True)
    counts = [F.count_if((F.col("label") == k) & live).alias(k) for k in ("TP", "FP", "FN")]
    if evaluation:
        counts.append(F.count_if(~live).alias("deleted"))
    # rows meet as columns, which are smaller than their text, and become text where they are
    g = rows.repartition("image").groupBy("image").agg(F.count("*").alias("total_features"), *counts, F.sort_array(F.collect_list(order)).alias("f"))
    meta = F.to_json(F.struct("total_features", *[c for c in ("TP", "FP", "FN", "deleted") if c != "deleted" or evaluation]))
    value = F.concat(F.lit('{"type":"FeatureCollection","metadata":'), meta, F.lit(',"features":['), F.array_join(F.col("f.json"), ","), F.lit("]}"))
    return g.select("image", value.alias("value"))


def write_collections(rows: DataFrame, path: str, evaluation: bool = False) -> None:
    """``{image}.geojson`` for each image, published together when all are written."""
    c = collections(rows, evaluation)
    write_text_files(c.select(F.concat(F.col("image").cast("string"), F.lit(".geojson")).alias("name"), "value"), path, "overwrite")


#: A collection whose features and metadata stay the text that they are.
RAW_COLLECTION = "metadata map<string,string>, features array<string>"


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``image, metadata, ordinal, feature`` of each file's features as text; a file without features keeps one row, its feature null."""
    df = spark.read.schema(RAW_COLLECTION).option("multiLine", True).json(path)
    return df.select(stem(F.input_file_name()).alias("image"), "metadata", F.posexplode_outer("features").alias("ordinal", "feature"))


def filtered_collections(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """``image, value``: the files of ``read_raw`` with only the features that ``kept (image, ordinal)`` names.

    Metadata are taken over from the source, with the new count of features;
    features come out as they were, in order, whatever properties they have.
    """
    stays = raw.join(kept.select("image", "ordinal", F.lit(True).alias("__stays")).distinct(), ["image", "ordinal"], "left")
    kept_text = F.when(F.col("__stays"), F.struct("ordinal", "feature"))
    g = stays.groupBy("image").agg(F.first("metadata", True).alias("m"), F.array_sort(F.collect_list(kept_text)).alias("f"))
    # values of the metadata are JSON already, but for texts, which were read without their quotes
    number = r"^(-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null|[\[{].*)$"
    text = lambda v: F.when(v.rlike(number), v).otherwise(F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", ""))
    total = F.size("f").cast("string")
    old = F.map_filter(F.coalesce("m", F.create_map().cast("map<string,string>")), lambda k, _: k != "total_features")
    named = lambda k, v: F.concat(F.lit('"'), k, F.lit('":'), v)
    meta = F.array_join(F.concat(F.transform(F.map_entries(old), lambda e: named(e["key"], text(e["value"]))), F.array(named(F.lit("total_features"), total))), ",")
    value = F.concat(F.lit('{"type":"FeatureCollection","metadata":{'), meta, F.lit('},"features":['), F.array_join(F.col("f.feature"), ","), F.lit("]}"))
    return g.select("image", value.alias("value"))


def write_filtered(raw: DataFrame, kept: DataFrame, path: str) -> None:
    """``{image}.geojson`` of ``filtered_collections``, published together when all are written."""
    c = filtered_collections(raw, kept)
    write_text_files(c.select(F.concat(F.col("image").cast("string"), F.lit(".geojson")).alias("name"), "value"), path, "overwrite")
