"""Label text: ``class x1 y1 x2 y2 x3 y3 x4 y4`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.geometry import point
from tessera.sources.files import write_text_files
from tessera.sources.geojson import stem

INTEGER, NUMBER = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``image, line_no, raw``: the lines of label files, numbered within each file.

    A file of no bytes has no line; ``rasters.list_files`` lists it, and
    ``image_profile`` keeps its image.
    """
    whole = spark.read.text(path, wholetext=True)
    return whole.select(stem(F.input_file_name()).alias("image"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "raw"))


def parse(lines: DataFrame) -> DataFrame:
    """``image, line_no, class_id, corners``: lines of another form are dropped."""
    t = lines.withColumn("__t", F.split(F.trim(F.regexp_replace("raw", r"\s+", " ")), " "))
    good = (F.size("__t") == 9) & F.col("__t")[0].rlike(INTEGER) & F.forall(F.slice("__t", 2, 8), lambda v: v.rlike(NUMBER))
    v = lambda i: F.col("__t")[i].try_cast("double")
    corners = F.array(*[point(v(i), v(i + 1)) for i in (1, 3, 5, 7)])
    return t.where(good).select("image", "line_no", F.col("__t")[0].try_cast("int").alias("class_id"), corners.alias("corners"))


def class_profile(lines: DataFrame) -> DataFrame:
    """``image, class_id, n`` by the first token; a file counts up to its first bad line."""
    t = lines.where(F.trim("raw") != "").withColumn("__c", F.regexp_extract("raw", r"^\s*(\S+)", 1))
    t = t.withColumn("class_id", F.when(F.col("__c").rlike(INTEGER), F.col("__c").try_cast("int")))
    bad = F.min(F.when(F.col("class_id").isNull(), F.col("line_no"))).over(Window.partitionBy("image"))
    return t.withColumn("__bad", bad).where("__bad is null or line_no < __bad").groupBy("image", "class_id").agg(F.count("*").alias("n"))


def image_profile(images: DataFrame, lines: DataFrame) -> DataFrame:
    """``image, class_id, n`` with a row of class null and 0 for each image that has no label: a background image."""
    return images.select("image").distinct().join(class_profile(lines), "image", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def format_lines(labels: DataFrame) -> DataFrame:
    """Add ``line``: the class and eight coordinates with six decimals."""
    xy = F.flatten(F.transform("corners", lambda p: F.array(p["x"], p["y"])))
    number = F.transform(xy, lambda v: F.format_string("%.6f", v))
    return labels.withColumn("line", F.concat_ws(" ", F.col("class_id").cast("string"), number))


def files(labels: DataFrame, images: DataFrame, order: str = "line_no", final_newline: bool = True) -> DataFrame:
    """``image, value``: the text of each image's label file; an image without labels has an empty one."""
    g = format_lines(labels).groupBy("image").agg(F.sort_array(F.collect_list(F.struct(order, "line"))).alias("l"))
    text = F.array_join(F.col("l.line"), "\n")
    body = F.when(F.size("l") > 0, F.concat(text, F.lit("\n")) if final_newline else text)
    return images.select("image").distinct().join(g, "image", "left").select("image", F.coalesce(body, F.lit("")).alias("value"))


def write_files(labels: DataFrame, images: DataFrame, path: str, final_newline: bool = True) -> None:
    """``{image}.txt`` for each image, published together when all are written."""
    rows = files(labels, images, final_newline=final_newline)
    write_text_files(rows.select(F.concat(F.col("image").cast("string"), F.lit(".txt")).alias("name"), "value"), path, "overwrite")
