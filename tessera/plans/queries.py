"""Queries over the test tables, each with its SQL twin.

Measures with a fraction are rounded by ``floor(v * 1e6 + 0.5) / 1e6`` on both
sides where the order of additions may differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.crs import ALPHA, ECCENTRICITY, RECTIFYING, SCALE, reproject_between
from tessera.functions.geometry import area, centroid, least_sides, normalised, point, rectangle, to_pixels, to_world
from tessera.functions.overlap import visible_fraction
from tessera.functions.repair import repaired
from tessera.operators import annotate, detections, grid, masks, metrics, raster, split, tiling, windows
from tessera.operators.dissolve import dissolve
from tessera.operators.ordinals import with_ordinals
from tessera.plans.derived import (
    BOXES, COASTLINES, IMAGES, PIXELS, boxes, coastlines, embedding_rows, images, read, sql_area, sql_clipped, sql_pairs,
)
from tessera.sources import geojson, labels, tiff
from tessera.sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def micro(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5) / 1e6


def sql_micro(e: str) -> str:
    return f"floor(({e}) * 1e6 + 5e-1) / 1e6"


# ------------------------------------------------------------ metric tables


def _labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "TP").when(F.col("quality") == 1, "FN").otherwise("FP")
    return d.join(read(spark, sf_dir, "labels"), "doc_id").select(
        F.col("source").alias("image"), F.col("lang").alias("class_name"), ((F.col("n_chars") % 101) / 100.0).alias("confidence"),
        label.alias("label"), F.lit(False).alias("deleted"),
    )


_FEATURES = """feats AS (SELECT source AS image, lang AS class_name, (n_chars % 101) / 1e2 AS confidence,
    CASE WHEN quality = 1 AND toxic = 0 THEN 'TP' WHEN quality = 1 THEN 'FN' ELSE 'FP' END AS label
    FROM documents JOIN labels USING (doc_id))"""


def _sql_ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0e0 END"


_RATIOS = f"""r AS (SELECT *, {_sql_ratio('"TP"', '"TP" + "FP"')} AS "Precision", {_sql_ratio('"TP"', '"TP" + "FN"')} AS "Recall" FROM c)"""
_F1 = _sql_ratio('2e0 * "Precision" * "Recall"', '"Precision" + "Recall"')
_BIAS = _sql_ratio('("FP" - "FN") * 1e2', '"TP" + "FN"')


@query(f"""WITH {_FEATURES}, g AS (SELECT i::INT AS i, 1e-2 + i * 1e-2 AS threshold FROM range(50) t(i)),
  c AS (SELECT i, threshold, count(*) FILTER (label = 'TP' AND confidence >= threshold) AS "TP",
    count(*) FILTER (label = 'FP' AND confidence >= threshold) AS "FP",
    count(*) FILTER (label = 'FN' OR (label = 'TP' AND confidence < threshold)) AS "FN"
    FROM g CROSS JOIN (SELECT * FROM feats WHERE class_name = 'en') GROUP BY i, threshold), {_RATIOS}
  SELECT i, threshold, "TP", "FP", "FN", {_sql_ratio('"TP" * 1e2', '"TP" + "FP" + "FN"')} AS "share_TP",
    {_sql_ratio('"FP" * 1e2', '"TP" + "FP" + "FN"')} AS "share_FP", {_sql_ratio('"FN" * 1e2', '"TP" + "FP" + "FN"')} AS "share_FN",
    "Precision", "Recall", {_F1} AS "F1" FROM r""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_sweep(metrics.evaluation_filter(_labelled_documents(spark, sf_dir), "EN"))


_LANGS = ("de", "en", "es", "fr")


def _counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _labelled_documents(spark, sf_dir)
    cls = (F.array_position(F.array(*map(F.lit, _LANGS)), F.col("class_name")) - 1).cast("int")
    f = f.select("label", cls.alias("class_id"))
    return detections.class_counts(f.where("label <> 'FN'"), f)


@query(f"""WITH {_FEATURES}, c AS (SELECT coalesce(class_name, 'ALL_CLASSES') AS "Class", count(*) FILTER (label = 'TP') AS "TP",
    count(*) FILTER (label = 'FP') AS "FP", count(*) FILTER (label = 'FN') AS "FN" FROM feats GROUP BY ROLLUP (class_name)), {_RATIOS}
  SELECT "Class", "TP"::BIGINT AS "TP", "FP"::BIGINT AS "FP", "FN"::BIGINT AS "FN", "Precision", "Recall", {_F1} AS "F1", {_BIAS} AS "Bias (%)" FROM r""")
def metrics_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.table(_counts_by_lang(spark, sf_dir), dict(enumerate(_LANGS)))


@query(f"""WITH {_FEATURES} SELECT image, class_name, label, count(*) AS n FROM feats GROUP BY ALL""")
def class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled_documents(spark, sf_dir).groupBy("image", "class_name", "label").agg(F.count("*").alias("n"))


# ------------------------------------------------------------- detections


@query(f"""WITH {BOXES}, s AS (SELECT image, ordinal, ring, {sql_area('ring')} AS area FROM boxes)
  SELECT image, ordinal, {sql_micro('area')} AS area,
    {sql_micro('(ring[1].x + ring[2].x + ring[3].x + ring[4].x) / 4e0')} AS cx, {sql_micro('(ring[1].y + ring[2].y + ring[3].y + ring[4].y) / 4e0')} AS cy FROM s""")
def box_area_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("c", centroid(F.col("ring")))
    return b.select("image", "ordinal", micro(area(F.col("ring"))).alias("area"), micro(F.col("c.x")).alias("cx"), micro(F.col("c.y")).alias("cy"))


@query(f"""WITH {BOXES}, {sql_pairs('a.ordinal < b.ordinal')}
  SELECT image, class_id, a_ordinal, b_ordinal, {sql_micro('iou')} AS iou FROM pairs WHERE iou > 1e-9""")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = detections.iou_pairs(boxes(spark, sf_dir), None, 1e-9)
    return p.withColumn("iou", micro(F.col("iou")))


@query(f"""WITH {BOXES}, {sql_pairs('a.ordinal < b.ordinal')}
  SELECT image, class_id, a_ordinal, b_ordinal, floor(iou * 1e4 + 5e-1) / 1e4 AS iou FROM pairs WHERE iou > 1e-4""")
def iou_pairs_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with coordinates in degrees: a pixel is 2^-17 of one, so nothing is rounded, and no cell size is given."""
    b = boxes(spark, sf_dir)
    b = b.withColumn("ring", F.transform("ring", lambda p: point(p["x"] / 131072.0, p["y"] / 131072.0)))
    p = detections.iou_pairs(b, None, 1e-4)
    return p.withColumn("iou", F.floor(F.col("iou") * 1e4 + 0.5) / 1e4)


_NMS = f"""WITH RECURSIVE {BOXES}, {sql_pairs('a.ordinal <> b.ordinal AND (a.confidence > b.confidence OR (a.confidence = b.confidence AND a.ordinal < b.ordinal))')},
  ranked AS (SELECT image, class_id, ordinal, row_number() OVER (PARTITION BY image, class_id ORDER BY confidence DESC, ordinal) AS r FROM boxes),
  over_ AS (SELECT image, class_id, b_ordinal AS ordinal, list(a_ordinal) AS above FROM pairs WHERE iou >= 2e-1 GROUP BY ALL),
  row_ AS (SELECT image, class_id, r, ordinal, coalesce(above, []::BIGINT[]) AS above FROM ranked LEFT JOIN over_ USING (image, class_id, ordinal)),
  fold AS (SELECT DISTINCT image, class_id, 0::BIGINT AS r, []::BIGINT[] AS kept FROM boxes
    UNION ALL SELECT f.image, f.class_id, f.r + 1, CASE WHEN list_has_any(f.kept, n.above) THEN f.kept ELSE list_append(f.kept, n.ordinal) END
    FROM fold f JOIN row_ n ON n.image = f.image AND n.class_id = f.class_id AND n.r = f.r + 1),
  last_ AS (SELECT image, class_id, arg_max(kept, r) AS kept FROM fold GROUP BY ALL),
  nms AS (SELECT image, class_id, unnest(kept) AS ordinal FROM last_)"""


@query(f"{_NMS} SELECT image, class_id, ordinal, confidence FROM nms JOIN boxes USING (image, class_id, ordinal)")
def nms_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.suppress(boxes(spark, sf_dir), 0.2).select("image", "class_id", "ordinal", "confidence")


_CENTRE = "round((ring[1].x + ring[3].x) / 2e0, 3)", "round((ring[1].y + ring[3].y) / 2e0, 3)"


@query(f"""{_NMS}, mid AS (SELECT image, class_id, ordinal, {_CENTRE[0]} AS cx, {_CENTRE[1]} AS cy FROM boxes),
  kept AS (SELECT DISTINCT image, class_id, cx, cy FROM mid JOIN nms USING (image, class_id, ordinal))
  SELECT image, class_id, ordinal FROM mid ANTI JOIN kept USING (image, class_id, cx, cy)""")
def deleted_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suppression removed; a removed box with the centroid of a kept one, of which there are many here, doesn't count."""
    b = boxes(spark, sf_dir)
    return detections.deleted(b, detections.suppress(b, 0.2)).select("image", "class_id", "ordinal")


_MATCH = f"""WITH RECURSIVE {BOXES}, {sql_pairs('a.side = 0 AND b.side = 1')},
  cand AS (SELECT image, class_id, a_ordinal AS p, b_ordinal AS t, iou,
    row_number() OVER (PARTITION BY image, class_id ORDER BY a_confidence DESC, a_ordinal, iou DESC, b_ordinal DESC) AS r FROM pairs WHERE iou >= 2e-1),
  fold AS (SELECT DISTINCT image, class_id, 0::BIGINT AS r, []::BIGINT[] AS ps, []::BIGINT[] AS ts FROM cand
    UNION ALL SELECT f.image, f.class_id, f.r + 1,
      CASE WHEN list_contains(f.ps, n.p) OR list_contains(f.ts, n.t) THEN f.ps ELSE list_append(f.ps, n.p) END,
      CASE WHEN list_contains(f.ps, n.p) OR list_contains(f.ts, n.t) THEN f.ts ELSE list_append(f.ts, n.t) END
    FROM fold f JOIN cand n ON n.image = f.image AND n.class_id = f.class_id AND n.r = f.r + 1),
  last_ AS (SELECT image, class_id, arg_max(ps, r) AS ps, arg_max(ts, r) AS ts FROM fold GROUP BY ALL),
  matched AS (SELECT image, class_id, unnest(ps) AS p_ordinal, unnest(ts) AS t_ordinal FROM last_)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = boxes(spark, sf_dir)
    p, t = b.where("side = 0"), b.where("side = 1").withColumn("confidence", F.lit(None).cast("double"))
    return p, t, detections.match(p, t, 0.2)


@query(f"""{_MATCH} SELECT m.image, m.class_id, p_ordinal, t_ordinal, {sql_micro('iou')} AS iou FROM matched m
  JOIN cand c ON c.image = m.image AND c.class_id = m.class_id AND c.p = p_ordinal AND c.t = t_ordinal""")
def match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir)[2].withColumn("iou", micro(F.col("iou")))


_LABELLED = f"""{_MATCH}, lp AS (SELECT b.*, CASE WHEN p_ordinal IS NULL THEN 'FP' ELSE 'TP' END AS label FROM boxes b
    LEFT JOIN matched m ON m.image = b.image AND m.class_id = b.class_id AND m.p_ordinal = b.ordinal WHERE side = 0),
  lt AS (SELECT b.*, CASE WHEN t_ordinal IS NULL THEN 'FN' ELSE 'TP' END AS label FROM boxes b
    LEFT JOIN matched m ON m.image = b.image AND m.class_id = b.class_id AND m.t_ordinal = b.ordinal WHERE side = 1)"""


@query(f"""{_LABELLED} SELECT image, 0 AS branch, ordinal, label, class_id, confidence, CASE WHEN label = 'TP' THEN class_id END AS ground_truth FROM lp
  UNION ALL SELECT image, 1, ordinal, label, class_id, NULL, class_id FROM lt WHERE label = 'FN'""")
def labelled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t, m = _sides(spark, sf_dir)
    p, t = detections.labelled(p, t, m)
    rows = detections.evaluation_rows(p, t, p.where("false"))
    return rows.select("image", "branch", "ordinal", "label", "class_id", "confidence", "ground_truth")


@query(f"""{_LABELLED}, c AS (SELECT coalesce(class_id::VARCHAR, 'ALL_CLASSES') AS "Class", count(*) FILTER (label = 'TP' AND side = 0) AS "TP",
    count(*) FILTER (label = 'FP') AS "FP", count(*) FILTER (label = 'FN') AS "FN"
    FROM (SELECT class_id, label, side FROM lp UNION ALL SELECT class_id, label, side FROM lt) GROUP BY ROLLUP (class_id)), {_RATIOS}
  SELECT "Class", "TP"::BIGINT AS "TP", "FP"::BIGINT AS "FP", "FN"::BIGINT AS "FN", "Precision", "Recall", {_F1} AS "F1", {_BIAS} AS "Bias (%)" FROM r""")
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match, label, count and tabulate: the evaluation from end to end."""
    p, t, m = _sides(spark, sf_dir)
    return metrics.table(detections.class_counts(*detections.labelled(p, t, m)))


@query(f"""{_LABELLED}, g AS (SELECT image, class_id, p_ordinal AS ordinal, class_id AS ground_truth FROM matched)
  SELECT image, class_id, ordinal, label, ground_truth FROM lp LEFT JOIN g USING (image, class_id, ordinal)""")
def best_truth_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t, m = _sides(spark, sf_dir)
    p, t = detections.labelled(p, t, m)
    return detections.best_truth_class(p, t).select("image", "class_id", "ordinal", "label", "ground_truth")


# ----------------------------------------------------------- ring repair


def _spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with rings that cross themselves (class 0), run out and back (class 1), or are as they were."""
    corner = lambda i: F.col("ring")[i]
    along = lambda p, q, t: point(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t)
    bow = F.array(corner(0), corner(1), corner(3), along(corner(3), corner(2), 0.5))
    spike = F.array(corner(0), corner(1), along(corner(0), corner(1), 1.5), corner(1), corner(2), corner(3))
    return boxes(spark, sf_dir).withColumn("ring", F.when(F.col("class_id") == 0, bow).when(F.col("class_id") == 1, spike).otherwise(F.col("ring")))


@query(f"""WITH {BOXES}, b AS (SELECT image, ordinal, class_id, ring[1] AS a, ring[2] AS b, ring[4] AS c,
    {{'x': ring[4].x + (ring[3].x - ring[4].x) * 5e-1, 'y': ring[4].y + (ring[3].y - ring[4].y) * 5e-1}} AS d, {sql_area('ring')} AS whole FROM boxes),
  t AS (SELECT *, ((d.x - b.x) * (d.y - a.y) - (d.y - b.y) * (d.x - a.x)) / ((c.x - b.x) * (d.y - a.y) - (c.y - b.y) * (d.x - a.x)) AS t FROM b),
  x AS (SELECT *, b.x + (c.x - b.x) * t AS mx, b.y + (c.y - b.y) * t AS my FROM t),
  w AS (SELECT *, ((b.x - a.x) * (my - a.y) - (b.y - a.y) * (mx - a.x)) / 2e0 AS one, ((c.x - mx) * (d.y - my) - (c.y - my) * (d.x - mx)) / 2e0 AS two FROM x)
  SELECT image, ordinal, (CASE WHEN class_id = 0 THEN 3 ELSE 4 END)::INT AS corners, {sql_micro('CASE WHEN class_id <> 0 THEN whole WHEN (one > 0) = (one + two > 0) THEN abs(one) ELSE abs(two) END')} AS area FROM w""")
def ring_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that cross or retrace themselves, repaired: corners and area of what is left; no box is lost."""
    r = _spoiled(spark, sf_dir).withColumn("ring", repaired(F.col("ring")))
    return r.select("image", "ordinal", F.size("ring").alias("corners"), micro(area(F.col("ring"))).alias("area"))


# ------------------------------------------------------------------ masks

_COVERED = f"""WITH {BOXES}, {COASTLINES}, met AS (SELECT b.image, b.ordinal, mring AS sring, ring AS wring FROM boxes b JOIN masks m ON b.image = m.image),
  {sql_clipped('met')},
  inside AS (SELECT image, ordinal, sum({sql_area('p')}) AS area_in FROM clip4 GROUP BY ALL),
  share AS (SELECT b.*, CASE WHEN area_in IS NOT NULL THEN least(1e0, area_in / {sql_area('b.ring')}) END AS fraction FROM boxes b LEFT JOIN inside USING (image, ordinal))"""


# many shares are whole 128ths, which lie half-way between two millionths: rounded a little apart from there, the last bit doesn't matter
@query(f"{_COVERED} SELECT image, ordinal, floor(coalesce(fraction, 0e0) * 1e6 + 487e-3) / 1e6 AS fraction, fraction IS NOT NULL AS has_mask FROM share")
def mask_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = masks.covered(boxes(spark, sf_dir), coastlines(spark, sf_dir))
    return c.select("image", "ordinal", (F.floor(F.col("fraction") * 1e6 + 0.487) / 1e6).alias("fraction"), "has_mask")


_UNION = f"""WITH {BOXES}, m AS (SELECT p_partkey AS image, (8 + p_size % 14)::DOUBLE AS e FROM part WHERE p_partkey % 5 <> 0),
  rects AS (SELECT image, 1e0 AS sign, -2e1 AS x0, e + 219e-4 AS x1, 40071e-4 AS y0 FROM m UNION ALL SELECT image, 1e0, e - 50137e-4, e + 4e0, -2e1 FROM m UNION ALL SELECT image, -1e0, e - 50137e-4, e + 219e-4, 40071e-4 FROM m),
  met AS (SELECT b.image, b.ordinal, sign, [{{'x': x0, 'y': y0}}, {{'x': x1, 'y': y0}}, {{'x': x1, 'y': 6e1}}, {{'x': x0, 'y': 6e1}}] AS sring, ring AS wring FROM boxes b JOIN rects r ON b.image = r.image),
  {sql_clipped('met')}, inside AS (SELECT image, ordinal, sum(sign * {sql_area('p')}) AS area_in FROM clip4 GROUP BY ALL)"""


def _overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of two rectangles that overlap."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), (F.lit(8) + F.col("p_size") % 14).cast("double").alias("e")).where("image % 5 <> 0")
    both = F.array(rectangle(F.lit(-20.0), F.lit(4.0071), F.col("e") + 0.0219, F.lit(60.0)), rectangle(F.col("e") - 5.0137, F.lit(-20.0), F.col("e") + 4.0, F.lit(60.0)))
    return p.select("image", F.lit("coastline").alias("kind"), F.posexplode(both).alias("polygon_id", "ring"), F.lit(0).alias("ring_id"))


@query(f"{_UNION} SELECT image, ordinal FROM inside JOIN boxes USING (image, ordinal) WHERE area_in / {sql_area('ring')} >= 4.321e-1")
def mask_union_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by their share inside two mask polygons that overlap: what both cover counts once."""
    return masks.covered(boxes(spark, sf_dir), _overlapping(spark, sf_dir)).where("has_mask and fraction >= 0.4321").select("image", "ordinal")


@query(f"""WITH m AS (SELECT p_partkey AS image, (8 + p_size % 14)::DOUBLE AS e FROM part WHERE p_partkey % 5 <> 0)
  SELECT image, {sql_micro('(e + 200219e-4) * (6e1 - 40071e-4) + (4e0 + 50137e-4) * 8e1 - (219e-4 + 50137e-4) * (6e1 - 40071e-4)')} AS area FROM m""")
def mask_union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of every mask's union, from the pieces of its cells: some fifty cells a mask."""
    pieces = dissolve(_overlapping(spark, sf_dir), cell=11.0)
    return pieces.groupBy("image").agg(micro(F.sum(area(F.col("ring")))).alias("area"))


@query(f"{_COVERED} SELECT image, ordinal, class_id FROM share WHERE fraction IS NULL OR fraction >= 7.77e-1")
def mask_fraction_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.coastline_filter(boxes(spark, sf_dir), coastlines(spark, sf_dir), 0.777).select("image", "ordinal", "class_id")


@query(f"{_COVERED} SELECT image, ordinal, class_id FROM share WHERE fraction IS NULL OR fraction < 3.33e-1")
def mask_overlap_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = coastlines(spark, sf_dir).withColumn("kind", F.lit("buildings"))
    return masks.buildings_filter(boxes(spark, sf_dir), m, 0.333).select("image", "ordinal", "class_id")


@query(f"""{_COVERED}, k AS (SELECT image, ordinal FROM share WHERE fraction IS NULL OR fraction >= 7.77e-1)
  SELECT image, (count(*) - count(k.ordinal))::BIGINT AS removed FROM share LEFT JOIN k USING (image, ordinal) GROUP BY ROLLUP (image)""")
def mask_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return masks.removed_count(b, masks.coastline_filter(b, coastlines(spark, sf_dir), 0.777))


# ----------------------------------------------------------------- tiling

_GRID = f"""{IMAGES}, grid AS (SELECT *, ("col" * 576)::INT AS x_off, ("row" * 576)::INT AS y_off FROM
    (SELECT *, unnest(range(ceil(width / 576e0)::INT)) AS "col" FROM (SELECT *, unnest(range(ceil(height / 576e0)::INT)) AS "row" FROM images)))"""


@query(f"""WITH {_GRID} SELECT image, x_off, y_off, least(640, width - x_off)::INT AS w, least(640, height - y_off)::INT AS h,
  image::VARCHAR || '_' || x_off || '_' || y_off AS tile FROM grid""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiling.tile_grid(images(spark, sf_dir), 640, 64)
    return t.select("image", "x_off", "y_off", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), "tile")


@query(f"""WITH {IMAGES}, g AS (SELECT *, unnest(range(ceil(width / 224e0)::INT)) * 224 AS cx FROM images)
  SELECT image, cx::INT AS core_x, least(224, width - cx)::INT AS core_w, (cx - least(cx, 16))::INT AS read_x,
    (least(224, width - cx) + least(cx, 16) + least(width - cx - least(224, width - cx), 32 - least(cx, 16)))::INT AS read_w,
    greatest(1, round_even((cx + least(224, width - cx)) / 3e-1, 0)::INT - round_even(cx / 3e-1, 0)::INT)::INT AS out_w FROM g""")
def halo_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiling.output_window(tiling.halo_grid(images(spark, sf_dir), 256, 32), 0.3).where("row = 0")
    return t.select("image", *[F.col(c).cast("int").alias(c) for c in ("core_x", "core_w", "read_x", "read_w", "out_w")])


def _sql_halo(at: str, length: str, a: str, n: str) -> str:
    core = f"least(224, {length} - {at})"
    before = f"least({at}, 16)"
    return f"""{at}::INT AS core_{a}, ({core})::INT AS core_{n}, ({at} - {before})::INT AS read_{a},
    ({core} + {before} + least({length} - {at} - {core}, 32 - {before}))::INT AS read_{n}, round_even({at} / 3e-1, 0)::INT AS out_{a},
    greatest(1, round_even(({at} + {core}) / 3e-1, 0)::INT - round_even({at} / 3e-1, 0)::INT)::INT AS out_{n}, round_even({before} / 3e-1, 0)::INT AS crop_{a}"""


@query(f"""WITH {IMAGES}, g AS (SELECT *, unnest(range(ceil(width / 224e0)::INT)) * 224 AS cx FROM (SELECT *, unnest(range(ceil(height / 224e0)::INT)) * 224 AS cy FROM images))
  SELECT image, {_sql_halo('cx', 'width', 'x', 'w')}, {_sql_halo('cy', 'height', 'y', 'h')} FROM g""")
def halo_grid_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both axes of every tile: core, read window, output window and crop; ``halo_grid`` is the x axis of the first row."""
    t = tiling.halo_crop(tiling.output_window(tiling.halo_grid(images(spark, sf_dir), 256, 32), 0.3), 0.3)
    names = [f"{k}_{c}" for k in ("core", "read", "out") for c in "xywh"] + ["crop_x", "crop_y"]
    return t.select("image", *[F.col(c).cast("int").alias(c) for c in names])


@query(f"""WITH {_GRID} SELECT image::VARCHAR || '_' || x_off || '_' || y_off AS tile, image::VARCHAR AS source_image, x_off, y_off FROM grid""")
def tile_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tiling.tile_grid(images(spark, sf_dir), 640, 64).select("tile", "image")
    bad = names.select(F.concat(F.lit("x_"), F.col("image").cast("string")).alias("tile"))
    return tiling.parse_tile_names(names.select("tile").unionByName(bad)).select("tile", "source_image", "x_off", "y_off")


def _image_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as shares of a 40 x 40 field: labels of the images."""
    return boxes(spark, sf_dir).select(
        "image", F.col("ordinal").alias("line_no"), "class_id", F.transform("ring", lambda p: point(p["x"] / 40.0, p["y"] / 40.0)).alias("corners")
    )


_LABELS = "labels_ AS (SELECT image, ordinal AS line_no, class_id, list_transform(ring, lambda e: {'x': e.x / 4e1, 'y': e.y / 4e1}) AS corners FROM boxes)"


@query(f"""WITH {BOXES}, {_GRID}, {_LABELS},
  met AS (SELECT l.image, line_no, class_id, x_off, y_off, list_transform(corners, lambda e: {{'x': e.x * width, 'y': e.y * height}}) AS sring,
    [{{'x': x_off::DOUBLE, 'y': y_off::DOUBLE}}, {{'x': x_off + 64e1, 'y': y_off::DOUBLE}}, {{'x': x_off + 64e1, 'y': y_off + 64e1}}, {{'x': x_off::DOUBLE, 'y': y_off + 64e1}}] AS wring
    FROM labels_ l JOIN grid g ON l.image = g.image), {sql_clipped('met')},
  seen AS (SELECT *, {sql_area('p')} / {sql_area('sring')} AS visible FROM clip4)
  SELECT image::VARCHAR || '_' || x_off || '_' || y_off AS tile, image, line_no, class_id, {sql_micro('visible')} AS visible,
    {sql_micro('(sring[1].x - x_off) / 64e1')} AS x1, {sql_micro('(sring[1].y - y_off) / 64e1')} AS y1 FROM seen WHERE visible >= 1.23e-1""")
def label_tile_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = tiling.tile_grid(images(spark, sf_dir), 640, 64)
    p = tiling.project_labels(_image_labels(spark, sf_dir), tiles, 640, 64, 0.123)
    first = F.col("corners")[0]
    return p.select("tile", "image", "line_no", "class_id", micro(F.col("visible")).alias("visible"), micro(first["x"]).alias("x1"), micro(first["y"]).alias("y1"))


@query(f"""WITH {BOXES} SELECT image, ordinal, {sql_micro('ring[1].x')} AS x, {sql_micro('ring[1].y')} AS y FROM boxes""")
def image_tile_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To shares of a tile, to pixels, to map coordinates and back."""
    b = boxes(spark, sf_dir)
    shares = F.transform("ring", lambda p: point((p["x"] - 64.0) / 640.0, (p["y"] - 32.0) / 640.0))
    affine = F.struct(*[F.lit(v).alias(k) for k, v in zip("abcdef", (0.5, 0.125, 1000.0, 0.25, -0.5, 2000.0), strict=True)])
    px = b.withColumn("px", tiling.to_image_pixels(shares, F.lit(64.0), F.lit(32.0), 640))
    back = px.withColumn("r", to_pixels(to_world(F.col("px"), affine), affine))
    return back.select("image", "ordinal", micro(F.col("r")[0]["x"]).alias("x"), micro(F.col("r")[0]["y"]).alias("y"))


# ------------------------------------------------- projections and ordinals

_COSH = ", ".join(f"{a!r}::DOUBLE" for a in ALPHA)


def _sql_series(other: str) -> str:
    """The sums of the series along and across."""
    f, g = ("sin", "cosh") if other == "xi" else ("cos", "sinh")
    return f"list_sum(list_transform(range(1, 7), lambda k: [{_COSH}][k] * {f}(2e0 * k * xi) * {g}(2e0 * k * eta)))"


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, (1 + l_partkey % 60)::INT AS zone, l_suppkey % 2 = 1 AS south,
      6e0 * (1 + l_partkey % 60) - 183e0 + (l_suppkey % 61 - 30) / 1e1 AS lon, CASE WHEN l_suppkey % 2 = 1 THEN -1e0 ELSE 1e0 END * (l_orderkey % 80 + l_linenumber / 8e0) AS lat FROM lineitem),
  t AS (SELECT *, radians(lon) - radians(6e0 * zone - 183e0) AS dl, sinh(atanh(sin(radians(lat))) - {ECCENTRICITY!r}::DOUBLE * atanh({ECCENTRICITY!r}::DOUBLE * sin(radians(lat)))) AS t FROM p),
  q AS (SELECT *, atan2(t, cos(dl)) AS xi, asinh(sin(dl) / sqrt(t * t + cos(dl) * cos(dl))) AS eta FROM t)
  SELECT l_orderkey, l_linenumber, zone, floor((5e5 + {SCALE * RECTIFYING!r}::DOUBLE * (eta + {_sql_series('eta')})) * 1e2 + 487e-3) / 1e2 AS east,
    floor((CASE WHEN south THEN 1e7 ELSE 0e0 END + {SCALE * RECTIFYING!r}::DOUBLE * (xi + {_sql_series('xi')})) * 1e2 + 487e-3) / 1e2 AS north FROM q""")
def mixed_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points all over the world, each in the zone that its row names: 120 systems in one expression."""
    li = read(spark, sf_dir, "lineitem")
    zone, south = (1 + F.col("l_partkey") % 60).cast("int"), F.col("l_suppkey") % 2 == 1
    lon = 6.0 * zone - 183.0 + (F.col("l_suppkey") % 61 - 30) / 10.0
    lat = F.when(south, -1.0).otherwise(1.0) * (F.col("l_orderkey") % 80 + F.col("l_linenumber") / 8.0)
    crs = F.concat(F.when(south, "EPSG:327").otherwise("EPSG:326"), F.lpad(zone.cast("string"), 2, "0"))
    p = li.select("l_orderkey", "l_linenumber", zone.alias("zone"), reproject_between(F.array(point(lon, lat)), F.lit("EPSG:4326"), crs)[0].alias("p"))
    cm = lambda c: F.floor(c * 1e2 + 0.487) / 1e2
    return p.select("l_orderkey", "l_linenumber", "zone", cm(F.col("p.x")).alias("east"), cm(F.col("p.y")).alias("north"))


@query(f"""WITH {BOXES} SELECT image, ordinal, (row_number() OVER (ORDER BY class_id, image::VARCHAR, ordinal) - 1)::BIGINT AS place FROM boxes""")
def global_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every box in one order of all of them."""
    b = boxes(spark, sf_dir).select("image", "ordinal", "class_id", F.col("image").cast("string").alias("name"))
    return with_ordinals(b, "class_id", "name", "ordinal", name="place").select("image", "ordinal", "place")


# ----------------------------------------------------------------- labels

_RAW = """raw_ AS (SELECT l_orderkey AS image, l_linenumber AS line_no, CASE WHEN l_linenumber = 5 THEN 'a' WHEN l_linenumber = 6 THEN '1.0' ELSE (l_partkey % 12)::VARCHAR END AS cls,
    CASE WHEN l_partkey % 7 = 0 THEN ' 0.5 0.5' ELSE ' 0.5 0.25 0.75 0.25 0.75 0.5 0.5 0.5' END AS rest FROM lineitem)"""


def _label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    cls = F.when(F.col("l_linenumber") == 5, "a").when(F.col("l_linenumber") == 6, "1.0").otherwise((F.col("l_partkey") % 12).cast("string"))
    rest = F.when(F.col("l_partkey") % 7 == 0, " 0.5 0.5").otherwise(" 0.5 0.25 0.75 0.25 0.75 0.5 0.5 0.5")
    return li.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("line_no"), F.concat(cls, rest).alias("raw"))


@query(f"""WITH {_RAW} SELECT image, line_no, cls::INT AS class_id, 7.5e-1 AS x2, 5e-1 AS y4 FROM raw_ WHERE length(rest) > 12 AND regexp_full_match(cls, '\\d+')""")
def label_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labels.parse(_label_lines(spark, sf_dir))
    return p.select("image", "line_no", "class_id", F.col("corners")[1]["x"].alias("x2"), F.col("corners")[3]["y"].alias("y4"))


@query(f"""WITH {_RAW}, b AS (SELECT *, min(CASE WHEN NOT regexp_full_match(cls, '\\d+') THEN line_no END) OVER (PARTITION BY image) AS bad FROM raw_)
  SELECT image, cls::INT AS class_id, count(*) AS n FROM b WHERE bad IS NULL OR line_no < bad GROUP BY ALL""")
def label_class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.class_profile(_label_lines(spark, sf_dir))


@query(f"""WITH {BOXES} SELECT image, ordinal, concat_ws(' ', class_id, printf('%.6f', ring[1].x), printf('%.6f', ring[1].y), printf('%.6f', ring[2].x),
    printf('%.6f', ring[2].y), printf('%.6f', ring[3].x), printf('%.6f', ring[3].y), printf('%.6f', ring[4].x), printf('%.6f', ring[4].y)) AS line
  FROM (SELECT image, ordinal, class_id, list_transform(ring, lambda e: {{'x': floor(e.x * 64e0) / 64e0, 'y': floor(e.y * 64e0) / 64e0}}) AS ring FROM boxes)""")
def label_line_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    sixty = F.transform("ring", lambda p: point(F.floor(p["x"] * 64.0) / 64.0, F.floor(p["y"] * 64.0) / 64.0))
    return labels.format_lines(boxes(spark, sf_dir).withColumn("corners", sixty)).select("image", "ordinal", "line")


#: A class table with merged and skipped classes.
CLASS_MAP, SKIPPED = {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2, 8: 0, 10: 0}, (9, 11)
_MAPPED = "CASE " + " ".join(f"WHEN c = {k} THEN {v}" for k, v in CLASS_MAP.items())


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("image"), (F.col("p_size") % 12).alias("class_id"))


@query(f"SELECT p_partkey AS image, {_MAPPED} END AS class_id FROM (SELECT p_partkey, p_size % 12 AS c FROM part) WHERE c NOT IN (9, 11, 7)")
def class_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.remap_classes(_sized(spark, sf_dir), CLASS_MAP, SKIPPED)


@query(f"SELECT p_partkey AS image, {_MAPPED} ELSE c END AS class_id FROM (SELECT p_partkey, p_size % 12 AS c FROM part) WHERE c NOT IN (9, 11)")
def label_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.remap_classes(_sized(spark, sf_dir), CLASS_MAP, SKIPPED, unknown="keep")


_AXIS = lambda p, q, dx, dy: f"""CASE WHEN sqrt(({q}.x - {p}.x) * ({q}.x - {p}.x) + ({q}.y - {p}.y) * ({q}.y - {p}.y)) > 1e-9
    THEN {{'x': ({q}.x - {p}.x) / n * greatest(n / 2e0, 3e0), 'y': ({q}.y - {p}.y) / n * greatest(n / 2e0, 3e0)}} ELSE {{'x': {dx}, 'y': {dy}}} END"""  # noqa: E731


@query(f"""WITH {BOXES}, a AS (SELECT image, ordinal, ring, {_AXIS('ring[1]', 'ring[2]', '3e0', '0e0').replace(' n ', ' sqrt((ring[2].x - ring[1].x) * (ring[2].x - ring[1].x) + (ring[2].y - ring[1].y) * (ring[2].y - ring[1].y)) ').replace('(n ', '(sqrt((ring[2].x - ring[1].x) * (ring[2].x - ring[1].x) + (ring[2].y - ring[1].y) * (ring[2].y - ring[1].y)) ')} AS a,
    {_AXIS('ring[1]', 'ring[4]', '0e0', '3e0').replace(' n ', ' sqrt((ring[4].x - ring[1].x) * (ring[4].x - ring[1].x) + (ring[4].y - ring[1].y) * (ring[4].y - ring[1].y)) ').replace('(n ', '(sqrt((ring[4].x - ring[1].x) * (ring[4].x - ring[1].x) + (ring[4].y - ring[1].y) * (ring[4].y - ring[1].y)) ')} AS b,
    (ring[1].x + ring[2].x + ring[3].x + ring[4].x) / 4e0 AS cx, (ring[1].y + ring[2].y + ring[3].y + ring[4].y) / 4e0 AS cy FROM boxes)
  SELECT image, ordinal, {sql_micro('greatest(0e0, least(1e0, (cx - a.x - b.x) / 3e1))')} AS x1, {sql_micro('greatest(0e0, least(1e0, (cy - a.y - b.y) / 3e1))')} AS y1,
    {sql_micro('greatest(0e0, least(1e0, (cx + a.x + b.x) / 3e1))')} AS x3, {sql_micro('greatest(0e0, least(1e0, (cy + a.y + b.y) / 3e1))')} AS y3 FROM a""")
def annotate_min_side_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("r", normalised(least_sides(F.col("ring"), 6.0), F.lit(30.0), F.lit(30.0)))
    at = lambda i, c, name: micro(F.col("r")[i][c]).alias(name)
    return b.select("image", "ordinal", at(0, "x", "x1"), at(0, "y", "y1"), at(2, "x", "x3"), at(2, "y", "y3"))


@query(f"""WITH {BOXES}, met AS (SELECT image, ordinal, class_id, ring AS sring, [{{'x': 0e0, 'y': 0e0}}, {{'x': 3e1, 'y': 0e0}}, {{'x': 3e1, 'y': 25e0}}, {{'x': 0e0, 'y': 25e0}}] AS wring FROM boxes),
  {sql_clipped('met')} SELECT image, ordinal, class_id FROM clip4 WHERE {sql_area('p')} / {sql_area('sring')} >= 4.567e-1""")
def visible_in_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = rectangle(F.lit(0.0), F.lit(0.0), F.lit(30.0), F.lit(25.0))
    return boxes(spark, sf_dir).where(visible_fraction(F.col("ring"), frame) >= 0.4567).select("image", "ordinal", "class_id")


@query(f"""WITH {BOXES} SELECT class_id, count(*) AS n, {sql_micro('avg(greatest(a, b))')} AS long_side, {sql_micro('avg(least(a, b))')} AS short_side FROM
  (SELECT class_id, sqrt((ring[2].x - ring[1].x) ** 2 + (ring[2].y - ring[1].y) ** 2) AS a, sqrt((ring[4].x - ring[1].x) ** 2 + (ring[4].y - ring[1].y) ** 2) AS b FROM boxes) GROUP BY class_id""")
def size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = annotate.size_summary(boxes(spark, sf_dir))
    return s.select("class_id", "n", micro(F.col("long_side")).alias("long_side"), micro(F.col("short_side")).alias("short_side"))


# ----------------------------------------------------------------- rasters

_PARAMS = """params AS (SELECT event_type AS image, quantile_cont(value, 1e-2) FILTER (value > 0) AS lo, quantile_cont(value, 9.99e-1) FILTER (value > 0) AS hi FROM events GROUP BY event_type)"""


@query(f"WITH {_PARAMS} SELECT image, {sql_micro('lo')} AS lo, {sql_micro('hi')} AS hi FROM params")
def radiometric_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("image"), "value")
    p = raster.stretch_params(e, ["image"])
    return p.select("image", micro(F.col("lo")).alias("lo"), micro(F.col("hi")).alias("hi"))


@query(f"""WITH {_PARAMS}, v AS (SELECT event_id, greatest(0::FLOAT, least(1::FLOAT, (value::FLOAT - lo::FLOAT) / (hi::FLOAT - lo::FLOAT))) AS u FROM events JOIN params ON image = event_type)
  SELECT event_id, greatest(1, least(254, trunc((u * 253::FLOAT)::FLOAT + 1::FLOAT)::INT))::INT AS pixel FROM v""")
def radiometric_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("image"), "value")
    p = raster.stretch_params(e, ["image"])
    return e.join(p, "image").select("event_id", raster.stretched(F.col("value"), F.col("lo"), F.col("hi")).alias("pixel"))


def _filled_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding_rows(spark, sf_dir)
    # a row of 64 pixels in square tiles of 18: the row repeated, so every tile is filled below
    t = tiling.tile_grid(rows.select("image", F.size("pixels").alias("width"), F.lit(18).alias("height")), 18)
    flat = rows.withColumn("row_off", F.explode(F.sequence(F.lit(0), F.lit(17))))
    return tiling.tile_pixels(flat, t, 18)


@query(f"""WITH {PIXELS}, t AS (SELECT image, unnest(range(4)) AS k, pixels FROM pixels), u AS (SELECT image, k, list_slice(pixels, k * 18 + 1, least(k * 18 + 18, 64)) AS part FROM t)
  SELECT image, image::VARCHAR || '_' || (k * 18) || '_0' AS tile, (CASE WHEN len(part) < 18 THEN greatest(list_max(part), 0) ELSE list_max(part) END)::INT AS hi FROM u
  WHERE list_min(part) <> list_max(part) OR (len(part) < 18 AND list_max(part) <> 0)""")
def uniform_tile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _filled_tiles(spark, sf_dir).where("line = 0")
    return kept.select("image", "tile", F.array_max("pixels").alias("hi"))


@query(f"""WITH {PIXELS}, t AS (SELECT image, unnest(range(4)) AS k, pixels FROM pixels), u AS (SELECT image, k, list_slice(pixels, k * 18 + 1, least(k * 18 + 18, 64)) AS part FROM t)
  SELECT image, image::VARCHAR || '_' || (k * 18) || '_0' AS tile, line::INT AS line, list_sum(part)::BIGINT AS total FROM u, range(18) r(line)
  WHERE list_min(part) <> list_max(part) OR (len(part) < 18 AND list_max(part) <> 0)""")
def uniform_tile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of every line of the kept tiles."""
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v)
    return _filled_tiles(spark, sf_dir).select("image", "tile", F.col("line").cast("int").alias("line"), total.alias("total"))


@query()
def uniform_tile_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the kept tiles; ``uniform_tile_filter`` is their first line, as far as its SQL goes."""
    return _filled_tiles(spark, sf_dir).select("image", "tile", "band", "line", "pixels")


@query(f"""WITH {PIXELS}, n AS (SELECT image, pixels, unnest(range(96)) AS i FROM pixels)
  SELECT image, (i + 1)::INT AS i, pixels[least(floor((i + 5e-1) * 64 / 96e0), 63)::INT + 1] AS pixel FROM n""")
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raster.resample_nearest(embedding_rows(spark, sf_dir), 1.5).where("row_off = 0")
    return r.select("image", F.posexplode("pixels").alias("i", "pixel")).withColumn("i", F.col("i") + 1)


@query(f"""WITH {PIXELS}, n AS (SELECT image, pixels, unnest(range(96)) AS i FROM pixels)
  SELECT image, 0::INT AS band, row_off::INT AS row_off, (i + 1)::INT AS i, pixels[least(floor((i + 5e-1) * 64 / 96e0), 63)::INT + 1] AS pixel FROM n, range(2) r(row_off)""")
def resample_nearest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All new rows; ``resample_nearest`` is the first of each image, as far as its SQL goes."""
    r = raster.resample_nearest(embedding_rows(spark, sf_dir), 1.5)
    return r.select("image", "band", "row_off", F.posexplode("pixels").alias("i", "pixel")).withColumn("i", F.col("i") + 1)


@query(f"""WITH {IMAGES} SELECT image, greatest(1, round_even(width * 37e-2, 0)::INT)::INT AS new_width, greatest(1, round_even(height * 37e-2, 0)::INT)::INT AS new_height,
  {sql_micro('greatest(1, round_even(width * 37e-2, 0)::INT) / width')} AS sx FROM images""")
def scaled_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = raster.scaled_meta(images(spark, sf_dir), 0.37)
    return m.select("image", "new_width", "new_height", micro(F.col("sx")).alias("sx"))


@query("""WITH b AS (SELECT p_partkey AS image, (1 + p_size % 5)::INT AS n FROM part)
  SELECT image, k::INT AS channel, (CASE WHEN n >= 3 THEN k ELSE 0 END)::INT AS band FROM b, range(3) t(k)""")
def band_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), (F.lit(1) + F.col("p_size") % 5).alias("n_bands"))
    return raster.band_channels(b)


@query()
def degrade_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blur, noise and shrinking of 8 x 8 tiles made of embeddings; seeded, so results repeat."""
    t = embedding_rows(spark, sf_dir).where("size(pixels) = 64").select(
        F.col("image").cast("string").alias("image"), F.col("image").cast("int").alias("tile_no"), F.lit(1).alias("n_bands"),
        F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("pixels", lambda v: v * 20.0).alias("pixels"),
    )
    steps = [{"op": "blur", "kernel_sizes": [3, 5]}, {"op": "noise"}, {"op": "resize", "scale": 2.0}]
    return raster.degrade(t, steps, seed=7)


def _blocks(spark: SparkSession, sf_dir: str, side: int = 3) -> tuple[DataFrame, DataFrame]:
    """Embeddings as images of eight by eight pixels in blocks of ``side``, the last ones smaller, and their sizes."""
    rows = embedding_rows(spark, sf_dir).where("size(pixels) = 64")
    steps = F.sequence(F.lit(0), F.lit(7), F.lit(side))
    b = rows.withColumn("row_off", F.explode(steps)).withColumn("col_off", F.explode(steps))
    h, w = (F.least(F.lit(side), F.lit(8) - F.col(c)) for c in ("row_off", "col_off"))
    line = lambda r: F.slice("pixels", r * 8 + F.col("col_off") + 1, F.least(F.lit(side), F.lit(8) - F.col("col_off")))
    part = F.flatten(F.transform(F.sequence(F.col("row_off"), F.col("row_off") + h - 1), line))
    blocks = b.select("image", "band", "row_off", "col_off", h.alias("h"), w.alias("w"), part.alias("pixels"))
    return blocks, rows.select("image", F.lit(8).alias("width"), F.lit(8).alias("height"))


def _exploded(blocks: DataFrame) -> DataFrame:
    """A row for each pixel of blocks: ``image, band, y, x, v``."""
    e = blocks.select("image", "band", "row_off", "col_off", "w", F.posexplode("pixels").alias("k", "v"))
    y, x = F.col("row_off") + (F.col("k") / F.col("w")).cast("int"), F.col("col_off") + F.col("k") % F.col("w")
    return e.select("image", "band", y.cast("int").alias("y"), x.cast("int").alias("x"), "v")


def _sql_axis(o: str, i: str, length: int, new: int) -> str:
    return f"greatest(0e0, 1e0 - abs({i} - (({o} + 5e-1) * {length}e0 / {new}e0 - 5e-1)))"


@query(f"""WITH {PIXELS}, w AS (SELECT o, i, wt / sum(wt) OVER (PARTITION BY o) AS wt FROM (SELECT o, i, {_sql_axis('o', 'i', 8, 12)} AS wt FROM range(12) a(o), range(8) b(i))),
  p AS (SELECT image, unnest(range(64)) AS k, unnest(pixels) AS v FROM pixels WHERE len(pixels) = 64),
  q AS (SELECT image, k // 8 AS i, k % 8 AS j, v FROM p), r AS (SELECT image, j, o AS y, sum(wt * v) AS v FROM q JOIN w USING (i) WHERE wt > 0 GROUP BY ALL)
  SELECT image, 0::INT AS band, y::INT AS y, w.o::INT AS x, floor(sum(wt * v) * 1e6 + 487e-3) / 1e6 AS v FROM r JOIN w ON w.i = r.j AND wt > 0 GROUP BY image, y, w.o""")
def resample_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine blocks of an image scaled by a half more: every pixel is that of the image scaled as a whole."""
    r = _exploded(windows.resample(*_blocks(spark, sf_dir), 1.5, "bilinear"))
    return r.withColumn("v", F.floor(F.col("v") * 1e6 + 0.487) / 1e6)


@query(f"""WITH {PIXELS}, p AS (SELECT image, unnest(range(64)) AS k, unnest(pixels) AS v FROM pixels WHERE len(pixels) = 64), t AS (SELECT y0, x0 FROM range(0, 8, 5) a(y0), range(0, 8, 5) b(x0)),
  q AS (SELECT image, y0, x0, (k // 8 - y0)::INT AS y, (k % 8 - x0)::INT AS x, v FROM p JOIN t ON k // 8 BETWEEN y0 AND y0 + 5 AND k % 8 BETWEEN x0 AND x0 + 5),
  c AS (SELECT *, (y0 + 6 > 8 OR x0 + 6 > 8) AS cut FROM q),
  k AS (SELECT image, y0, x0 FROM c GROUP BY ALL HAVING min(CASE WHEN cut THEN least(v, 0) ELSE v END) < max(CASE WHEN cut THEN greatest(v, 0) ELSE v END))
  SELECT image::VARCHAR || '_' || x0 || '_' || y0 AS tile, sum(v)::BIGINT AS total, sum(v * (y * 6 + x + 1))::BIGINT AS placed FROM c JOIN k USING (image, y0, x0) GROUP BY image, y0, x0""")
def tile_pixel_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of six pixels, one of overlap, out of blocks of three: their pixels and places."""
    blocks, sizes = _blocks(spark, sf_dir)
    t = windows.cut_tiles(blocks, tiling.tile_grid(sizes, 6, 1), 6)
    at = lambda weigh: F.aggregate(F.transform("pixels", weigh), F.lit(0.0), lambda a, v: a + v).cast("long")
    return t.select("tile", at(lambda v, k: v).alias("total"), at(lambda v, k: v * (k + 1)).alias("placed"))


@query(f"""WITH {PIXELS}, p AS (SELECT image, unnest(range(64)) AS k, unnest(pixels) AS v FROM pixels WHERE len(pixels) = 64)
  SELECT image, 0::INT AS band, (k // 8)::INT AS y, (k % 8)::INT AS x, (CASE image % 3 WHEN 0 THEN least(v * 90, 255) WHEN 1 THEN least(v * 9000, 65535) ELSE v / 8e0 END)::DOUBLE AS v FROM p""")
def degrade_pixel_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 8 and 16 bits and of fractions through halo tiles, no step changing them: whole pixels saturate, all come back where they were."""
    blocks, sizes = _blocks(spark, sf_dir)
    k = F.col("image") % 3
    bright = F.transform("pixels", lambda v: F.when(k == 0, v * 90.0).when(k == 1, v * 9000.0).otherwise(v / 8.0))
    sizes = sizes.withColumn("dtype", F.when(k == 0, "uint8").when(k == 1, "uint16").otherwise("float32"))
    return _exploded(windows.degrade_images(blocks.withColumn("pixels", bright), sizes, [{"op": "resize", "scale": 1.0}], 4, 2))


@query(f"""WITH {PIXELS}, p AS (SELECT image // 64 AS image, (image % 64)::INT AS row_off, pixels FROM pixels WHERE len(pixels) = 64 AND image % 64 BETWEEN 10 AND 20)
  SELECT image::VARCHAR AS image, row_off, list_sum(list_transform(range(1, 65), lambda i: pixels[i] * i))::BIGINT AS placed FROM p""")
def tiff_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 64 embeddings each, written as GeoTIFF files, of which the strips of a window are read back."""
    rows = embedding_rows(spark, sf_dir).where("size(pixels) = 64").withColumn("row_off", (F.col("image") % 64).cast("int")).withColumn("image", F.floor(F.col("image") / 64).cast("string"))
    blocks = rows.select("image", "band", "row_off", F.lit(0).alias("col_off"), F.lit(1).alias("h"), F.lit(64).alias("w"), "pixels")
    meta = rows.groupBy("image").agg(F.lit(64).alias("width"), (F.max("row_off") + 1).alias("height"), F.lit(1).alias("n_bands"), F.lit("uint8").alias("dtype"))
    path = scratch_path(spark)
    tiff.write_tiff(blocks, meta, path)
    read = tiff.read_blocks(spark, tiff.tiff_paths(spark, path), (10, 0, 11, 64))
    return read.select("image", "row_off", F.aggregate(F.transform("pixels", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v).cast("long").alias("placed"))


# ------------------------------------------------------------------- split

_PROFILE = """profile AS (SELECT conv_id AS image, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS class_id, count(*) AS n FROM conversations GROUP BY ALL)"""


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    cls = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    return split.profiles(c.select(F.col("conv_id").alias("image"), cls.alias("class_id")))


@query("""WITH s AS (SELECT p_size AS n, split, i, n * r AS exact FROM (SELECT DISTINCT p_size FROM part) JOIN
    (VALUES (0, 'train', 7e-1), (1, 'val', 15e-2), (2, 'test', 15e-2)) v(i, split, r) ON true),
  k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY floor(exact) - exact, i) AS k, n - sum(floor(exact)) OVER (PARTITION BY n) AS spare FROM s)
  SELECT n::BIGINT AS n, split, (floor(exact) + CASE WHEN k <= spare THEN 1 ELSE 0 END)::BIGINT AS capacity FROM k""")
def split_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("n")).distinct()
    return split.capacities(n, (0.7, 0.15, 0.15))


@query(f"WITH {_PROFILE} SELECT class_id::INT AS class_id, sum(n)::BIGINT AS total, sum(n)::BIGINT * 7e-1 AS train, sum(n)::BIGINT * 15e-2 AS val, sum(n)::BIGINT * 15e-2 AS test FROM profile GROUP BY class_id")
def split_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.targets(_profile(spark, sf_dir), (0.7, 0.15, 0.15))


@query(f"""WITH {_PROFILE}, t AS (SELECT class_id, sum(n)::BIGINT AS total FROM profile GROUP BY class_id)
  SELECT image, split, {sql_micro('sum(CASE WHEN class_id = 0 THEN 3e0 ELSE 1e0 END * least(total * r, n))')} AS score
  FROM profile JOIN t USING (class_id), (VALUES ('train', 7e-1), ('val', 15e-2), ('test', 15e-2)) v(split, r) GROUP BY image, split""")
def split_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, cfg = _profile(spark, sf_dir), split.SplitConfig(priority=(0,))
    return split.scores(p, split.targets(p, cfg.ratios), cfg).withColumn("score", micro(F.col("score")))


@query()
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _profile(spark, sf_dir).withColumn("image", F.format_string("%08d", "image"))
    return split.assign(p.select("image"), p, split.SplitConfig(priority=(0,)))


@query()
def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _profile(spark, sf_dir).withColumn("image", F.format_string("%08d", "image"))
    return split.distribution(p, split.assign(p.select("image"), p, split.SplitConfig(priority=(0,)), ties="first"))


# -------------------------------------------------------------------- grid

_RUNS = """runs AS (SELECT (row_number() OVER (ORDER BY a, b, c, d) - 1)::INT AS ordinal, up, t, n, arch, 'up' || u || '_cl' || n AS preproc_key,
    'up' || u || '_t' || t || '_cl' || n AS tiling_key, 'up' || u || '_t' || t || '_cl' || n || '_' || arch AS run_id
  FROM (VALUES (0, 1e0, '1'), (1, 2e0, '2'), (2, 4e0, '4')) x(a, up, u), (VALUES (0, 640), (1, 1024), (2, 1536)) y(b, t),
    (VALUES (0, 6), (1, 4)) z(c, n), (VALUES (0, 'std'), (1, 'p2')) w(d, arch))"""
_STEPS = """steps AS (SELECT (row_number() OVER (ORDER BY k, first) - 1)::INT AS index, stage, key FROM (
    SELECT 0 AS k, 'preproc' AS stage, preproc_key AS key, min(ordinal) AS first FROM runs GROUP BY preproc_key UNION ALL
    SELECT 1, 'tiling', tiling_key, min(ordinal) FROM runs GROUP BY tiling_key UNION ALL SELECT 2, 'train', run_id, ordinal FROM runs))"""


@query(f"WITH {_RUNS} SELECT ordinal, run_id, up AS upscale_ratio, t AS tile_size, n AS n_classes, arch AS arch_id, preproc_key, tiling_key FROM runs")
def grid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.runs(spark)


@query(f"WITH {_RUNS}, {_STEPS} SELECT index, stage, key FROM steps")
def grid_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.steps(grid.runs(spark))


@query(f"""WITH {_RUNS}, {_STEPS}, o AS (SELECT r.run_id, count(s.key) AS bad, min(CASE s.stage WHEN 'preproc' THEN 0 WHEN 'tiling' THEN 1 ELSE 2 END) AS at,
    arg_min(s.index % 7 = 0, CASE s.stage WHEN 'preproc' THEN 0 WHEN 'tiling' THEN 1 ELSE 2 END) AS oom FROM runs r
    LEFT JOIN (SELECT * FROM steps WHERE index % 5 = 2) s ON s.key IN (r.preproc_key, r.tiling_key, r.run_id) GROUP BY r.run_id)
  SELECT CASE WHEN bad = 0 THEN 'success' WHEN oom THEN 'oom' ELSE 'failed' END AS status, count(*) AS runs FROM o GROUP BY ALL""")
def grid_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = grid.runs(spark)
    failed = grid.steps(runs).where("index % 5 = 2").select("stage", "key", (F.col("index") % 7 == 0).alias("oom"))
    return grid.status_counts(grid.outcomes(runs, failed))


# ----------------------------------------------------------------- GeoJSON


@query(f"""WITH {BOXES} SELECT image::VARCHAR AS image, ordinal, class_id, confidence, {sql_micro('ring[3].x')} AS x3, 4::INT AS corners FROM boxes""")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes to feature text and back."""
    b = boxes(spark, sf_dir).withColumns({
        "label": F.lit(None).cast("string"), "class_name": F.col("class_id").cast("string"), "source_tile": F.lit(None).cast("string"),
        "image": F.col("image").cast("string"),
    })
    f = b.select("ordinal", F.from_json(geojson.feature_json(), geojson.FEATURE).alias("f"))
    r = f.select("ordinal", "f.properties.*", geojson.open_ring(F.col("f.geometry.coordinates")[0]).alias("ring"))
    return r.select(
        F.col("source_image").alias("image"), "ordinal", "class_id", "confidence", micro(F.col("ring")[2]["x"]).alias("x3"), F.size("ring").alias("corners")
    )


@query(f"""{_LABELLED}, f AS (SELECT image, label FROM lp) SELECT image, count(*) AS total, count(*) FILTER (label = 'TP') AS tp, count(*) FILTER (label = 'FP') AS fp FROM f GROUP BY image""")
def geojson_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collection for each image, read back for its counts."""
    p, t, m = _sides(spark, sf_dir)
    p = detections.labelled(p, t, m)[0].withColumns({"class_name": F.col("class_id").cast("string"), "source_tile": F.lit(None).cast("string")})
    c = geojson.collections(p).withColumn("j", F.from_json("value", geojson.COLLECTION))
    meta = lambda k: F.col("j.metadata")[k]
    return c.select("image", F.size("j.features").cast("long").alias("total"), meta("TP").alias("tp"), meta("FP").alias("fp"))
