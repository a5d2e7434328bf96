import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, geojson, labels, rasters


def texts(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f)).read() for d, _, names in os.walk(folder) if "_staged" not in d for f in names}


def test_listing(spark, tmp_path):
    for name, size in (("a.tif", 3), ("b.tif", 0), ("c.txt", 1), ("sub/d.TIF", 2), ("sub/deep/er/e.tiff", 1), ("other/f.tif", 4)):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    rows = lambda df: sorted((r["name"], r["length"], r["status"]) for r in df.collect())
    flat = files.listing(spark, str(tmp_path), "*.tif")
    assert rows(flat) == [("a.tif", 3, "ok"), ("b.tif", 0, "empty")]
    deep = files.listing(spark, str(tmp_path), rasters.EXTENSIONS, True)
    assert rows(deep) == [("a.tif", 3, "ok"), ("b.tif", 0, "empty"), ("d.TIF", 2, "ok"), ("e.tiff", 1, "ok"), ("f.tif", 4, "ok")]
    assert deep.rdd.getNumPartitions() == 3  # the top and each folder below it
    assert all(os.path.exists(r["path"]) for r in deep.collect())
    some = files.listing(spark, [str(tmp_path / "a.tif"), str(tmp_path / "gone.tif"), f"file://{tmp_path}/sub"], "*")
    assert rows(some) == [("a.tif", 3, "ok"), ("d.TIF", 2, "ok"), ("gone.tif", None, "missing")]
    assert files.first_file(spark, str(tmp_path)).endswith("/a.tif") and files.first_file(spark, str(tmp_path), "*.png") is None
    assert [r["path"].rsplit("/", 1)[1] for r in rasters.list_files(spark, str(tmp_path), True).collect()][:2] == ["a.tif", "b.tif"]
    with pytest.raises(FileNotFoundError, match="no .*png under"):
        rasters.list_files(spark, str(tmp_path), pattern="*.png")


def test_text_files_are_published_together(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(f"{k % 2}/n{k}.txt", f"value {k} é\n") for k in range(20)], "name string, value string").repartition(4)
    files.write_text_files(df, out)
    want = {f"{k % 2}/n{k}.txt": f"value {k} é\n" for k in range(20)}
    assert texts(out) == want
    files.write_text_files(spark.createDataFrame([("0/n0.txt", "new"), ("z.txt", None)], "name string, value string"), out)
    assert texts(out) == want | {"0/n0.txt": "new", "z.txt": ""}
    files.write_text_files(spark.createDataFrame([("only.txt", "x")], "name string, value string"), out, "overwrite")
    assert texts(out) == {"only.txt": "x"}
    # a task that fails, and two rows of one name, leave everything as it was
    for bad in (df.withColumn("value", F.when(F.col("name") == "1/n7.txt", F.raise_error(F.lit("broken"))).otherwise(F.col("value"))), df.unionByName(df.limit(1)), df.withColumn("name", F.lit("../up"))):
        with pytest.raises(Exception, match="broken|several rows|not a file name"):
            files.write_text_files(bad, out, "overwrite")
        assert texts(out) == {"only.txt": "x"}


def test_label_files(spark, tmp_path):
    schema = "image string, line_no int, class_id int, corners array<struct<x:double,y:double>>"
    rows = spark.createDataFrame([("i", 1, 3, [(0.5, 0.25)] * 4), ("i", 0, 2, [(0.0, 1.0)] * 4)], schema)
    labels.write_files(rows, spark.createDataFrame([("i",), ("bare",)], "image string"), str(tmp_path / "l"))
    got = texts(tmp_path / "l")
    assert set(got) == {"i.txt", "bare.txt"} and got["bare.txt"] == "" and got["i.txt"].startswith("2 0.000000 1.000000")
    back = labels.parse(labels.read_lines(spark, str(tmp_path / "l" / "*.txt")))
    assert sorted((r["image"], r["line_no"], r["class_id"]) for r in back.collect()) == [("i", 0, 2), ("i", 1, 3)], got


def test_filtered_collections_keep_what_they_had(spark, tmp_path):
    feature = lambda k: {"type": "Feature", "properties": {"class_id": k, "extra": {"a": [1, "ü"]}}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
    meta = {"total_features": 3, "source": "scene \"7\"", "threshold": 0.25, "nested": {"k": [1, 2]}, "flag": True, "none": None}
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "metadata": meta, "features": [feature(k) for k in range(3)]}))
    (tmp_path / "in" / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(9)]}, indent=1))
    (tmp_path / "in" / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "metadata": {"x": 1}, "features": []}))
    raw = geojson.read_raw(spark, str(tmp_path / "in"))
    kept = spark.createDataFrame([("a", 2), ("a", 0), ("a", 0)], "image string, ordinal int")
    geojson.write_filtered(raw, kept, str(tmp_path / "out"))
    got = {k: json.loads(v) for k, v in texts(tmp_path / "out").items()}
    assert set(got) == {"a.geojson", "b.geojson", "c.geojson"}
    assert got["a.geojson"]["features"] == [feature(0), feature(2)]
    assert {k: v for k, v in got["a.geojson"]["metadata"].items() if k != "none"} == {k: v for k, v in meta.items() if k != "none"} | {"total_features": 2}
    assert got["b.geojson"] == {"type": "FeatureCollection", "metadata": {"total_features": 0}, "features": []}
    assert got["c.geojson"]["metadata"] == {"x": 1, "total_features": 0}


def test_missing_evaluation_files_are_skipped(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"label": "FN", "class_id": 1}, "geometry": None}]}))
    paths = [str(tmp_path / "a.geojson"), str(tmp_path / "gone.geojson")]
    got = geojson.read_features(spark, paths).collect()
    assert [(r["image"], r["label"], r["ring"]) for r in got] == [("a", "FN", None)]
    assert geojson.read_features(spark, paths[1:]).count() == 0


def test_spoiled_rings_in_files(spark, tmp_path):
    bow = [[0, 0], [6, 0], [0, 4], [2, 4], [0, 0]]
    feature = lambda c, geometry: {"type": "Feature", "properties": {"class_id": c, "confidence": 0.5}, "geometry": geometry}
    (tmp_path / "a.geojson").write_text(json.dumps({"features": [feature(1, {"type": "Polygon", "coordinates": [bow]}), feature(2, {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 0]]]}), feature(3, None)]}))
    got = geojson.valid_detections(geojson.read_features(spark, str(tmp_path / "a.geojson"))).collect()
    assert [(r["class_id"], len(r["ring"])) for r in got] == [(1, 3)]
    masks = geojson.polygons(spark, str(tmp_path / "a.geojson"), "coastline").collect()
    assert len(masks) == 1 and len(masks[0]["ring"]) == 3
    (tmp_path / "bare.geojson").write_text(json.dumps({"features": [feature(2, {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [2, 2], [0, 0]]]})]}))
    (tmp_path / "none.geojson").write_text(json.dumps({"features": []}))
    for name in ("bare", "none"):
        with pytest.raises(Exception, match=f"no usable polygon in the mask of {name}"):
            geojson.polygons(spark, str(tmp_path / f"{name}.geojson"), "coastline").collect()
