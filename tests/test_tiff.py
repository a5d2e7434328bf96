import os
import struct
import zlib

import numpy as np
import pytest

from tessera.sources import tiff
from tests.test_windows import BLOCKS, blocks_of, image_of

META = "image string, width int, height int, n_bands int, dtype string, nodata double, crs string, affine struct<a:double,b:double,c:double,d:double,e:double,f:double>, tags map<string,string>"


def meta_row(name, a, dtype, **more):
    return (name, a.shape[2], a.shape[1], a.shape[0], dtype, more.get("nodata"), more.get("crs"), more.get("affine"), more.get("tags"))


@pytest.mark.parametrize("compress", ["deflate", "none"])
def test_round_trip(spark, tmp_path, compress):
    rng = np.random.default_rng(2)
    images = {
        "rgb": (rng.integers(0, 256, (3, 40, 50)).astype(float), "uint8", 16, 32), "one": (rng.integers(-3000, 3000, (1, 33, 7)).astype(float), "int16", 10, 7),
        "real": (rng.normal(size=(2, 20, 20)), "float64", 20, 20), "deep": (rng.integers(0, 65536, (1, 1, 1)).astype(float), "uint16", 1, 1),
    }
    affine = (0.5, 0.0, 300000.0, 0.0, -0.5, 4500000.0)
    rows = [r for n, (a, _, bh, bw) in images.items() for r in blocks_of({n: a}, bh, bw)]
    metas = [meta_row(n, a, t, crs="EPSG:32631" if n == "rgb" else None, affine=affine if n == "rgb" else None, nodata=-1.0 if n == "one" else None, tags={"k": 'a "b" & <c>'} if n == "real" else None) for n, (a, t, *_) in images.items()]
    out = str(tmp_path / "out")
    tiff.write_tiff(spark.createDataFrame(rows, BLOCKS).repartition(3), spark.createDataFrame(metas, META), out, compress=compress)
    assert sorted(os.listdir(out)) == sorted(f"{n}.tif" for n in images)
    paths = tiff.tiff_paths(spark, out)
    got = tiff.read_blocks(spark, paths, stripes=2).collect()
    for n, (a, *_) in images.items():
        assert np.array_equal(image_of(got, n, a.shape), a)
    meta = {r["image"]: r for r in tiff.read_meta(spark, [*paths, f"{out}/gone.tif"]).collect()}
    assert (meta["rgb"]["crs"], tuple(meta["rgb"]["affine"]), meta["rgb"]["dtype"], meta["rgb"]["block_h"], meta["rgb"]["block_w"]) == ("EPSG:32631", affine, "uint8", 16, 32)
    assert meta["one"]["nodata"] == -1 and meta["one"]["crs"] is None and "&amp;" in meta["real"]["tags"] and meta["deep"]["width"] == 1
    assert meta["gone"]["status"].startswith("unreadable") and meta["gone"]["width"] is None


def test_a_window_opens_only_its_blocks(spark, tmp_path):
    a = np.arange(64 * 96.0).reshape(1, 64, 96)
    out = str(tmp_path / "out")
    tiff.write_tiff(spark.createDataFrame(blocks_of({"a": a, "b": a + 1}, 16, 16), BLOCKS), spark.createDataFrame([meta_row(n, a, "uint16") for n in "ab"], META), out)
    paths = tiff.tiff_paths(spark, out)
    some = tiff.read_blocks(spark, paths, (20, 30, 5, 20))
    assert sorted((r["image"], r["row_off"], r["col_off"]) for r in some.collect()) == [(i, 16, x) for i in "ab" for x in (16, 32, 48)]
    # bytes outside of the window may be anything: they aren't read
    with open(paths[0], "r+b") as f:
        info = tiff.layout(__import__("pyarrow").fs.LocalFileSystem().open_input_file(paths[0]))
        f.seek(info.offsets[0])
        f.write(b"\xff" * info.sizes[0])
    assert tiff.read_blocks(spark, paths[0], (20, 30, 5, 20)).count() == 3
    with pytest.raises(Exception, match="(?i)decompress|header|invalid"):
        tiff.read_blocks(spark, paths[0]).collect()
    # filters are pushed into the source: the spoiled block is never opened
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        where = "row_off >= 16 and row_off < 48 and col_off = 32"
        assert sorted((r["image"], r["row_off"]) for r in tiff.read_blocks(spark, paths, pushdown=True).where(where).collect()) == [(i, y) for i in "ab" for y in (16, 32)]
        assert tiff.read_blocks(spark, paths, pushdown=True).where("image = 'b'").count() == 24
        assert tiff.read_blocks(spark, paths, pushdown=True).where("image in ('b', 'z') and row_off > 16 and row_off <= 32 and h = 16").count() == 6
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def classic(a, order, predictor, planar_chunky=True):
    """A small striped file of another writer's kind: classic header, bands side by side, maybe differences."""
    h, w, n = a.shape
    rows, strips, at = 2, [], 8
    for y in range(0, h, rows):
        part = a[y : y + rows].astype(np.int64)
        if predictor == 2:
            part = np.diff(part, axis=1, prepend=0)
        strips.append(zlib.compress(part.astype(np.dtype("u1")).tobytes()))
    offsets = []
    for s in strips:
        offsets.append(at)
        at += len(s)
    extra = at
    longs = lambda v: struct.pack(f"{order}{len(v)}I", *v)
    blob = longs(offsets) + longs([len(s) for s in strips]) + struct.pack(f"{order}3d", 2.0, 2.0, 0.0) + struct.pack(f"{order}6d", 0, 0, 0, 100.0, 200.0, 0)
    entry = lambda t, k, m, v: struct.pack(f"{order}HHI", t, k, m) + (struct.pack(f"{order}HH", v, 0) if k == 3 and m == 1 else struct.pack(f"{order}I", v))
    m = len(strips)
    entries = [entry(256, 3, 1, w), entry(257, 3, 1, h), entry(258, 3, 1, 8), entry(259, 3, 1, 8), entry(273, 4, m, extra), entry(277, 3, 1, n), entry(278, 3, 1, rows), entry(279, 4, m, extra + 4 * m), entry(317, 3, 1, predictor), entry(33550, 12, 3, extra + 8 * m), entry(33922, 12, 6, extra + 8 * m + 24)]
    ifd = struct.pack(f"{order}H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, extra + len(blob)) + b"".join(strips) + blob + ifd


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_files_of_other_writers(spark, tmp_path, order, predictor):
    a = np.random.default_rng(4).integers(0, 256, (7, 5, 3))
    (tmp_path / "x.tif").write_bytes(classic(a, order, predictor))
    got = tiff.read_blocks(spark, str(tmp_path / "x.tif")).collect()
    assert np.array_equal(image_of(got, "x", (3, 7, 5)), np.moveaxis(a, 2, 0))
    meta = tiff.read_meta(spark, str(tmp_path / "x.tif")).first()
    assert tuple(meta["affine"]) == (2.0, 0.0, 100.0, 0.0, -2.0, 200.0) and meta["n_bands"] == 3


def test_what_cannot_be_written_or_read(spark, tmp_path):
    a = np.zeros((1, 40, 40))
    meta = spark.createDataFrame([meta_row("a", a, "uint8")], META)
    for rows in (blocks_of({"a": a}, 10, 10), blocks_of({"a": a}, 16, 16)[:3] + [("a", 0, 8, 0, 16, 16, [0.0] * 256)]):
        with pytest.raises(Exception, match="neither whole rows|not on the grid"):
            tiff.write_tiff(spark.createDataFrame(rows, BLOCKS), meta, str(tmp_path / "bad"))
    assert not [f for f in os.listdir(tmp_path / "bad") if f.endswith(".tif")]
    (tmp_path / "no.tif").write_bytes(b"hello, this is no image at all")
    assert "not a TIFF" in tiff.read_meta(spark, str(tmp_path / "no.tif")).first()["status"]
    # whole types saturate, and what no block covers is 0
    part = spark.createDataFrame([("a", 0, 16, 16, 16, 16, [300.0, -5.0, float("nan")] + [1.0] * 253)], BLOCKS)
    tiff.write_tiff(part, meta, str(tmp_path / "part"))
    got = image_of(tiff.read_blocks(spark, str(tmp_path / "part" / "a.tif")).collect(), "a", (1, 40, 40))
    assert got[0, 16, 16:20].tolist() == [255, 0, 0, 1] and got.sum() == 255 + 253
