"""Detections, rasters and labels derived from the test tables, in Spark and in SQL.

Box rotations are rational, and both sides use the same operations in the same
order, so coordinates are equal to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.geometry import oriented_box, rectangle

TURNS = ((1.0, 0.0), (3 / 5, 4 / 5), (5 / 13, 12 / 13), (8 / 17, 15 / 17))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One oriented box for each lineitem; a part is an image."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    k = F.col("l_orderkey") % 4
    turn = lambda i: F.when(k == 0, TURNS[0][i]).when(k == 1, TURNS[1][i]).when(k == 2, TURNS[2][i]).otherwise(TURNS[3][i])
    d = li.select(
        F.col("l_partkey").alias("image"),
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000 + F.col("l_suppkey") % 1000) * 64 + F.col("l_quantity").cast("long")).alias("ordinal"),
        (F.col("l_linenumber") % 3).cast("int").alias("class_id"),
        (((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 1000) / 1000.0).alias("confidence"),
        ((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % 37).cast("double").alias("cx"),
        ((F.col("l_suppkey") * 3 + F.col("l_linenumber") * 5) % 29).cast("double").alias("cy"),
        (F.lit(4.0) + F.col("l_quantity") % 9).alias("w"),
        (F.lit(3.0) + F.col("l_suppkey") % 5).cast("double").alias("h"),
        turn(0).alias("c"), turn(1).alias("s"), (F.col("l_orderkey") % 2).cast("int").alias("side"),
    )
    ring = oriented_box(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.col("c"), F.col("s"))
    return d.select("image", "ordinal", "class_id", "confidence", "side", ring.alias("ring"))


def _sql_turn(i: int) -> str:
    v = [f"{a[i]!r}::DOUBLE" for a in TURNS]
    return f"CASE l_orderkey % 4 WHEN 0 THEN {v[0]} WHEN 1 THEN {v[1]} WHEN 2 THEN {v[2]} ELSE {v[3]} END"


def _sql_corner(sx: str, sy: str) -> str:
    return f"{{'x': cx + ({sx}::DOUBLE * w * c - {sy}::DOUBLE * h * s), 'y': cy + ({sx}::DOUBLE * w * s + {sy}::DOUBLE * h * c)}}"


BOXES = f"""
  lines AS (SELECT l_partkey AS image, ((l_orderkey * 8 + l_linenumber) * 1000 + l_suppkey % 1000) * 64 + l_quantity::BIGINT AS ordinal, (l_linenumber % 3)::INT AS class_id,
      ((l_orderkey * 31 + l_linenumber * 17) % 1000) / 1e3 AS confidence,
      ((l_orderkey * 7 + l_suppkey) % 37)::DOUBLE AS cx, ((l_suppkey * 3 + l_linenumber * 5) % 29)::DOUBLE AS cy,
      4e0 + l_quantity % 9 AS w, (3 + l_suppkey % 5)::DOUBLE AS h, {_sql_turn(0)} AS c, {_sql_turn(1)} AS s,
      (l_orderkey % 2)::INT AS side FROM lineitem),
  boxes AS (SELECT image, ordinal, class_id, confidence, side,
      [{_sql_corner('-0.5', '-0.5')}, {_sql_corner('0.5', '-0.5')}, {_sql_corner('0.5', '0.5')}, {_sql_corner('-0.5', '0.5')}] AS ring
      FROM lines)"""


def sql_area(ring: str) -> str:
    """Shoelace area of a list of points."""
    terms = f"list_transform(range(1, len({ring}) + 1), lambda i: {ring}[i].x * {ring}[i % len({ring}) + 1].y - {ring}[i % len({ring}) + 1].x * {ring}[i].y)"
    return f"(CASE WHEN len({ring}) < 3 THEN 0e0 ELSE abs(list_reduce({terms}, lambda a, t: a + t, 0e0)) / 2e0 END)"


def sql_clipped(source: str, window: str = "wring", subject: str = "sring", name: str = "clip") -> str:
    """CTEs ``name0 .. name4`` that clip ``subject`` of ``source`` by the four-cornered ``window``; ``p`` is the result."""
    out = [f"{name}0 AS MATERIALIZED (SELECT *, {subject} AS p FROM {source})"]
    for k in range(1, 5):
        ax, ay, bx, by = (f"{window}[{i}].{c}" for i, c in ((k, "x"), (k, "y"), (k % 4 + 1, "x"), (k % 4 + 1, "y")))
        side = f"(({bx} - {ax}) * (e.y - {ay}) - ({by} - {ay}) * (e.x - {ax}))"
        out.append(f"{name}{k}d AS MATERIALIZED (SELECT * EXCLUDE (p), p AS q, list_transform(p, lambda e: {side}) AS d FROM {name}{k - 1})")
        t = "(d[i] / (d[i] - d[i % len(q) + 1]))"
        meet = f"{{'x': q[i].x + (q[i % len(q) + 1].x - q[i].x) * {t}, 'y': q[i].y + (q[i % len(q) + 1].y - q[i].y) * {t}}}"
        step = (
            f"CASE WHEN d[i] >= 0 AND d[i % len(q) + 1] >= 0 THEN [q[i % len(q) + 1]] WHEN d[i] >= 0 THEN [{meet}] "
            f"WHEN d[i % len(q) + 1] >= 0 THEN [{meet}, q[i % len(q) + 1]] ELSE [] END"
        )
        out.append(f"{name}{k} AS MATERIALIZED (SELECT * EXCLUDE (q, d), flatten(list_transform(range(1, len(q) + 1), lambda i: {step})) AS p FROM {name}{k}d)")
    return ",\n  ".join(out)


def sql_bounds(ring: str, prefix: str) -> str:
    xs, ys = f"list_transform({ring}, lambda e: e.x)", f"list_transform({ring}, lambda e: e.y)"
    return f"list_min({xs}) AS {prefix}x0, list_max({xs}) AS {prefix}x1, list_min({ys}) AS {prefix}y0, list_max({ys}) AS {prefix}y1"


def sql_pairs(condition: str) -> str:
    """CTEs up to ``pairs``: boxes of an image and class whose bounds meet, with ``iou``."""
    return f"""bounded AS (SELECT *, {sql_bounds('ring', 'b')}, {sql_area('ring')} AS area FROM boxes),
  met AS (SELECT a.image, a.class_id, a.ordinal AS a_ordinal, b.ordinal AS b_ordinal, a.confidence AS a_confidence,
      b.confidence AS b_confidence, a.ring AS sring, b.ring AS wring, a.area AS a_area, b.area AS b_area
      FROM bounded a JOIN bounded b ON a.image = b.image AND a.class_id = b.class_id AND {condition}
      WHERE a.bx0 <= b.bx1 AND b.bx0 <= a.bx1 AND a.by0 <= b.by1 AND b.by0 <= a.by1),
  {sql_clipped('met')},
  parts AS (SELECT * EXCLUDE (sring, wring, p), {sql_area('p')} AS both_area FROM clip4),
  pairs AS (SELECT *, CASE WHEN a_area + b_area - both_area > 0 THEN both_area / (a_area + b_area - both_area) ELSE 0e0 END AS iou FROM parts)"""


def coastlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two disjoint mask rectangles for each part: the left part of the scene and a strip on its right."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), "p_size")
    edge = (F.lit(8) + F.col("p_size") % 14).cast("double")
    left = rectangle(F.lit(-20.0), F.lit(-20.0), edge, F.lit(60.0))
    strip = rectangle(edge + 3.0, F.lit(-20.0), edge + 9.0, F.lit(60.0))
    return p.where("image % 5 <> 0").select(
        "image", F.lit("coastline").alias("kind"), F.posexplode(F.array(left, strip)).alias("polygon_id", "ring"), F.lit(0).alias("ring_id")
    )


COASTLINES = """
  masks AS (SELECT p_partkey AS image, unnest([
      [{'x': -2e1, 'y': -2e1}, {'x': e, 'y': -2e1}, {'x': e, 'y': 6e1}, {'x': -2e1, 'y': 6e1}],
      [{'x': e + 3e0, 'y': -2e1}, {'x': e + 9e0, 'y': -2e1}, {'x': e + 9e0, 'y': 6e1}, {'x': e + 3e0, 'y': 6e1}]]) AS mring
      FROM (SELECT p_partkey, (8 + p_size % 14)::DOUBLE AS e FROM part WHERE p_partkey % 5 <> 0))"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image size for each part."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("image"),
        (F.lit(300) + (F.col("p_partkey") * 37) % 900).cast("int").alias("width"),
        (F.lit(200) + F.col("p_size") * 11).cast("int").alias("height"),
    )


IMAGES = "images AS (SELECT p_partkey AS image, (300 + (p_partkey * 37) % 900)::INT AS width, (200 + p_size * 11)::INT AS height FROM part)"


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as one-row images of quantised pixels."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("image"), F.lit(0).alias("band"), F.lit(0).alias("row_off"),
        F.transform("embedding", lambda v: F.greatest(F.lit(0), F.floor(v.cast("double") * 4.0 + 1.0)).cast("int")).alias("pixels"),
    )


PIXELS = "pixels AS (SELECT vec_id AS image, list_transform(embedding, lambda v: greatest(0, floor(v::DOUBLE * 4e0 + 1e0))::INT) AS pixels FROM embeddings)"
