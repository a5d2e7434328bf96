"""GeoTIFF files as pixel blocks: a source that opens only the blocks of a window, and a sink with a commit.

The source is planned by files and by stripes of each file's blocks; a task
reads a file's directory of blocks and then the bytes of those blocks that lie
in the window and pass the pushed filters on ``image``, ``row_off`` and
``col_off``.  Plain and Deflate-compressed strips and tiles of whole and
floating-point pixels are read, with or without horizontal differences; other
encodings are an error.  The sink writes strips or tiles as the blocks come, so
a task holds one block.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tessera.sources.files import StagedWriter, first_file, listing, opened

BLOCKS = "path string, image string, band int, row_off int, col_off int, h int, w int, pixels array<double>"
META = (
    "path string, image string, width int, height int, n_bands int, dtype string, block_h int, block_w int, nodata double, crs string, "
    "affine struct<a:double,b:double,c:double,d:double,e:double,f:double>, tags string, status string"
)
#: Fixed values of the format: tag numbers, bytes of the field types, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, MATRIX, GEOKEYS, METADATA, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42112, 42113
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946
PROJECTED, GEOGRAPHIC = 3072, 2048


@dataclass
class Layout:
    """What a file's first directory says of its pixels."""

    width: int
    height: int
    bands: int
    dtype: np.dtype
    block_h: int
    block_w: int
    offsets: tuple
    sizes: tuple
    compression: int
    predictor: int
    separate: bool
    nodata: float | None = None
    crs: str | None = None
    affine: tuple | None = None
    tags: str | None = None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_w)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_h)

    def blocks(self) -> Iterator[tuple[int, int, int, int, int, int]]:
        """``index, first band, row_off, col_off, h, w`` of each stored block."""
        for plane in range(self.bands if self.separate else 1):
            for r in range(self.down):
                for c in range(self.across):
                    y, x = r * self.block_h, c * self.block_w
                    yield (plane * self.down + r) * self.across + c, plane, y, x, min(self.block_h, self.height - y), min(self.block_w, self.width - x)


def layout(f: pa.NativeFile) -> Layout:
    """Read the header and the first directory of a file, classic or big."""
    head = f.read_at(16, 0)
    if head[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    order = "<" if head[:2] == b"II" else ">"
    big = struct.unpack_from(order + "H", head, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
    count, first, size, inline = ("Q", 8, 20, 8) if big else ("H", 2, 12, 4)
    n = struct.unpack(order + count, f.read_at(first, at))[0]
    raw = f.read_at(n * size, at + first)
    found: dict[int, tuple | bytes] = {}
    for k in range(n):
        tag, kind, many = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, k * size)
        if kind not in FIELD:
            continue
        fmt = f"{order}{many}s" if kind == 2 else order + FIELD[kind] * many
        length = struct.calcsize(fmt)
        place = k * size + (12 if big else 8)
        data = raw[place : place + length] if length <= inline else f.read_at(length, struct.unpack_from(order + ("Q" if big else "I"), raw, place)[0])
        found[tag] = struct.unpack(fmt, data)[0] if kind == 2 else struct.unpack(fmt, data)
    one = lambda tag, default=None: found[tag][0] if tag in found else default
    text = lambda tag: found[tag].rstrip(b"\0").decode("utf-8", "replace") if tag in found else None
    width, height, bands = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, kind = one(BITS, 1), {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
    if kind is None or bits not in (8, 16, 32, 64):
        raise ValueError(f"pixels of {bits} bits and format {one(FORMAT, 1)} are not supported")
    tiled = TILES in found
    out = Layout(
        width, height, bands, np.dtype(f"{order}{kind}{bits // 8}"), one(TILE_H) if tiled else min(one(ROWS, height), height), one(TILE_W) if tiled else width,
        found[TILES if tiled else STRIPS], found[TILE_BYTES if tiled else STRIP_BYTES], one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2 and bands > 1,
    )
    if out.compression not in (PLAIN, DEFLATE, OLD_DEFLATE) or out.predictor not in (1, 2) or (out.predictor == 2 and kind == "f"):
        raise ValueError(f"compression {out.compression} with predictor {out.predictor} is not supported")
    nodata = text(NODATA)
    out.nodata = float(nodata) if nodata and nodata.strip() else None
    out.tags = text(METADATA)
    if MATRIX in found:
        m = found[MATRIX]
        out.affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif SCALE in found and TIEPOINT in found:
        s, t = found[SCALE], found[TIEPOINT]
        out.affine = (s[0], 0.0, t[3] - t[0] * s[0], 0.0, -s[1], t[4] + t[1] * s[1])
    keys = found.get(GEOKEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    code = codes.get(PROJECTED) or codes.get(GEOGRAPHIC)
    out.crs = f"EPSG:{code}" if code and code != 32767 else None
    return out


def pixels(f: pa.NativeFile, at: Layout, index: int, h: int, w: int) -> np.ndarray:
    """A block's pixels (bands, h, w): all bands, or one where they are stored apart."""
    n = 1 if at.separate else at.bands
    if not at.sizes[index]:  # a block that was never written
        return np.zeros((n, h, w))
    raw = f.read_at(at.sizes[index], at.offsets[index])
    if at.compression != PLAIN:
        raw = zlib.decompress(raw)
    rows = h if at.block_w == at.width and len(raw) < at.block_h * at.block_w * n * at.dtype.itemsize else at.block_h
    a = np.frombuffer(raw, at.dtype, rows * at.block_w * n).reshape(rows, at.block_w, n)
    if at.predictor == 2:
        a = np.cumsum(a, axis=1, dtype=at.dtype)
    return np.moveaxis(a[:h, :w], 2, 0)


# -------------------------------------------------------------------- source


@dataclass
class Stripe(InputPartition):
    """Every ``of``-th block of a file, from the ``k``-th on."""

    path: str
    k: int
    of: int


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


@dataclass
class _Bounds:
    """What blocks must fulfil: a window, and filters pushed down on three columns."""

    window: tuple[int, int, int, int] | None = None
    images: set | None = None
    least: dict[str, int] = field(default_factory=dict)
    most: dict[str, int] = field(default_factory=dict)

    def take(self, f: Filter) -> bool:
        """Whether a filter can be checked before a block is read."""
        column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
        if column == "image" and isinstance(f, EqualTo | In):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.images = values if self.images is None else self.images & values
            return True
        if column not in ("row_off", "col_off") or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) or f.value is None:
            return False
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            self.least[column] = max(self.least.get(column, 0), f.value + isinstance(f, GreaterThan))
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            self.most[column] = min(self.most.get(column, f.value), f.value - isinstance(f, LessThan))
        return True

    def hold(self, y: int, x: int, h: int, w: int) -> bool:
        at = {"row_off": y, "col_off": x}
        if any(at[c] < v for c, v in self.least.items()) or any(at[c] > v for c, v in self.most.items()):
            return False
        if self.window is None:
            return True
        y0, x0, wh, ww = self.window
        return y < y0 + wh and y0 < y + h and x < x0 + ww and x0 < x + w


class _BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.stripes = int(options.get("stripes", "1"))
        window = options.get("window")
        self.bounds = _Bounds(tuple(int(v) for v in window.split(",")) if window else None)

    def partitions(self) -> list[InputPartition]:
        wanted = self.bounds.images
        return [Stripe(p, k, self.stripes) for p in self.paths if wanted is None or _stem(p) in wanted for k in range(self.stripes)]

    def read(self, partition: Stripe) -> Iterator[tuple]:
        system, at = opened(partition.path)
        with system.open_input_file(at) as f:
            info = layout(f)
            blocks = [b for b in info.blocks() if self.bounds.hold(*b[2:])]
            for index, plane, y, x, h, w in blocks[partition.k :: partition.of]:
                for k, a in enumerate(pixels(f, info, index, h, w)):
                    yield partition.path, _stem(partition.path), plane + k, y, x, h, w, a.astype(float).reshape(-1).tolist()


class _FilteredReader(_BlockReader):
    """A reader that takes filters; Spark accepts it only where Python sources may be given filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self.bounds.take(f):
                yield f


class _MetaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split("\n") if p]

    def partitions(self) -> list[InputPartition]:
        return [Stripe(p, 0, 1) for p in self.paths]

    def read(self, partition: Stripe) -> Iterator[tuple]:
        path = partition.path
        try:
            system, at = opened(path)
            with system.open_input_file(at) as f:
                i = layout(f)
        except (OSError, ValueError, struct.error, KeyError, TypeError) as e:
            yield path, _stem(path), *[None] * 10, f"unreadable: {e}"
            return
        yield path, _stem(path), i.width, i.height, i.bands, i.dtype.newbyteorder("=").name, i.block_h, i.block_w, i.nodata, i.crs, i.affine, i.tags, "ok"


class TiffSource(DataSource):
    """Format ``tessera_tiff``: ``what`` is blocks or meta; writes blocks as files."""

    @classmethod
    def name(cls) -> str:
        return "tessera_tiff"

    def schema(self) -> str:
        return META if self.options.get("what") == "meta" else BLOCKS

    def reader(self, schema) -> DataSourceReader:
        kinds = {"meta": _MetaReader, "filtered": _FilteredReader}
        return kinds.get(self.options.get("what"), _BlockReader)(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _TiffWriter(self.options["path"], overwrite, self.options.get("compress", "deflate") == "deflate")


def _load(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    spark.dataSource.register(TiffSource)
    if isinstance(paths, str):
        paths = [paths]
    return spark.read.format("tessera_tiff").options(paths="\n".join(paths), **options).load()


def read_blocks(
    spark: SparkSession, paths: str | list[str], window: tuple[int, int, int, int] | None = None, stripes: int = 1, pushdown: bool = False
) -> DataFrame:
    """Blocks of files, of a window ``(y, x, height, width)`` only those that it touches; large files are read by ``stripes`` tasks.

    With ``pushdown`` filters on ``image``, ``row_off`` and ``col_off`` reach the
    source; the session must have ``spark.sql.python.filterPushdown.enabled``.
    """
    more = {"window": ",".join(map(str, window))} if window else {}
    return _load(spark, paths, stripes=str(stripes), what="filtered" if pushdown else "blocks", **more)


def read_meta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each file; what can't be read has a ``status`` that says why and nulls otherwise."""
    return _load(spark, paths, what="meta")


def tiff_paths(spark: SparkSession, folder: str, recursive: bool = False) -> list[str]:
    """The names of a folder's files, for the readers above."""
    found = listing(spark, folder, ["*.tif", "*.TIF", "*.tiff", "*.TIFF"], recursive).where("status = 'ok'")
    return [r["path"] for r in found.select("path").orderBy("path").collect()]


def folder_crs(spark: SparkSession, folder: str) -> str | None:
    """The system of the first file of a folder, in name order; null where there is no file or it names none."""
    first = first_file(spark, folder)
    return None if first is None else read_meta(spark, first).first()["crs"]


# ---------------------------------------------------------------------- sink


class _File:
    """One file that grows block by block: bands apart, the directory of blocks last."""

    def __init__(self, out: pa.NativeFile, meta: dict, block_h: int, block_w: int, deflate: bool):
        self.out, self.meta, self.h, self.w, self.deflate = out, meta, block_h, block_w, deflate
        self.strips = block_w >= meta["width"]
        if not self.strips and (block_h % 16 or block_w % 16):
            raise ValueError(f"blocks of {block_h} x {block_w} are neither whole rows nor of sides that 16 divides")
        self.dtype = np.dtype(meta["dtype"]).newbyteorder("<")
        across, down = (1 if self.strips else -(-meta["width"] // block_w)), -(-meta["height"] // block_h)
        self.across, self.down = across, down
        self.offsets, self.sizes = [0] * (across * down * meta["n_bands"]), [0] * (across * down * meta["n_bands"])
        out.write(b"II\x2b\0\x08\0\0\0" + b"\0" * 8)
        self.at = 16

    def put(self, band: int, y: int, x: int, h: int, w: int, values: np.ndarray) -> None:
        if y % self.h or (x % self.w and not self.strips) or h != min(self.h, self.meta["height"] - y):
            raise ValueError(f"block at {y}, {x} of {self.meta['image']} is not on the grid of the first")
        a = values.reshape(h, w)
        if not self.strips:
            a = np.pad(a, ((0, self.h - h), (0, self.w - w)))
        if self.dtype.kind != "f":
            limits = np.iinfo(self.dtype)
            a = np.clip(np.nan_to_num(a), limits.min, limits.max)
        raw = np.ascontiguousarray(a).astype(self.dtype).tobytes()
        raw = zlib.compress(raw) if self.deflate else raw
        k = (band * self.down + y // self.h) * self.across + (0 if self.strips else x // self.w)
        self.offsets[k], self.sizes[k] = self.at, len(raw)
        self.out.write(raw)
        self.at += len(raw)

    def close(self, f: fs.FileSystem, path: str) -> None:
        m, n = self.meta, self.meta["n_bands"]
        entries: list[tuple[int, str, tuple | bytes]] = [
            (WIDTH, "I", (m["width"],)), (HEIGHT, "I", (m["height"],)), (BITS, "H", (self.dtype.itemsize * 8,) * n), (COMPRESSION, "H", (DEFLATE if self.deflate else PLAIN,)),
            (PHOTOMETRIC, "H", (2 if n == 3 and self.dtype.itemsize == 1 else 1,)), (SAMPLES, "H", (n,)), (PLANAR, "H", (2 if n > 1 else 1,)),
            (FORMAT, "H", ({"u": 1, "i": 2, "f": 3}[self.dtype.kind],) * n),
        ]
        if self.strips:
            entries += [(STRIPS, "Q", tuple(self.offsets)), (ROWS, "I", (self.h,)), (STRIP_BYTES, "Q", tuple(self.sizes))]
        else:
            entries += [(TILE_W, "I", (self.w,)), (TILE_H, "I", (self.h,)), (TILES, "Q", tuple(self.offsets)), (TILE_BYTES, "Q", tuple(self.sizes))]
        if m.get("affine"):
            a = [m["affine"][k] for k in "abcdef"]
            entries.append((MATRIX, "d", (a[0], a[1], 0.0, a[2], a[3], a[4], 0.0, a[5], *[0.0] * 7, 1.0)))
        if m.get("crs"):
            code = int(m["crs"].split(":")[1])
            geographic = 4000 <= code < 5000
            entries.append((GEOKEYS, "H", (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, code)))
        if m.get("nodata") is not None:
            entries.append((NODATA, "s", f"{m['nodata']:g}".encode() + b"\0"))
        if m.get("tags"):
            escaped = lambda v: str(v).replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
            items = "".join(f'<Item name="{escaped(k)}">{escaped(v)}</Item>' for k, v in m["tags"].items())
            entries.append((METADATA, "s", f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0"))
        kinds = {"s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}
        body, extra = b"", b""
        start = self.at + self.at % 2
        after = start + 8 + 20 * len(entries) + 8
        for tag, kind, value in sorted(entries):
            data = value if kind == "s" else struct.pack("<" + kind * len(value), *value)
            body += struct.pack("<HHQ", tag, kinds[kind], len(value))
            if len(data) <= 8:
                body += data.ljust(8, b"\0")
            else:
                body += struct.pack("<Q", after + len(extra))
                extra += data + b"\0" * (-len(data) % 8)
        self.out.write(b"\0" * (start - self.at) + struct.pack("<Q", len(entries)) + body + b"\0" * 8 + extra)
        self.out.close()
        self.directory = start


class _TiffWriter(StagedWriter):
    def __init__(self, path: str, overwrite: bool, deflate: bool):
        super().__init__(path, overwrite)
        self.deflate = deflate

    def put(self, batches: Iterator[pa.RecordBatch], folder: str, system: fs.FileSystem) -> list[str]:
        names: list[str] = []
        now: _File | None = None
        part = f"{folder}/.{uuid.uuid4().hex}"

        def done() -> None:
            if now is None:
                return
            now.close(system, part)
            name = f"{now.meta['name']}"
            if "/" in name:
                system.create_dir(f"{folder}/{name.rsplit('/', 1)[0]}", recursive=True)
            # the first bytes name the directory, which is known now: the file is copied behind them
            with system.open_input_file(part) as src, system.open_output_stream(f"{folder}/{name}") as out:
                out.write(b"II\x2b\0\x08\0\0\0" + struct.pack("<Q", now.directory))
                src.seek(16)
                while chunk := src.read(8 << 20):
                    out.write(chunk)
            system.delete_file(part)
            names.append(name)

        for b in batches:
            cols = {c: b.column(c) for c in b.schema.names}
            for i in range(b.num_rows):
                meta = cols["meta"][i].as_py()
                name = meta.get("name") or f"{meta['image']}.tif"
                if now is None or now.meta["name"] != name:
                    done()
                    meta["name"] = name
                    meta["tags"] = dict(meta["tags"]) if meta.get("tags") else None
                    now = _File(system.open_output_stream(part), meta, cols["h"][i].as_py(), cols["w"][i].as_py(), self.deflate)
                get = lambda c: cols[c][i].as_py()  # noqa: B023, E731
                now.put(get("band"), get("row_off"), get("col_off"), get("h"), get("w"), np.asarray(cols["pixels"][i].values.to_numpy(zero_copy_only=False), float))
        done()
        return names


def write_tiff(blocks: DataFrame, meta: DataFrame, path: str, mode: str = "append", compress: str = "deflate") -> None:
    """One file for each image, published together when all are written.

    ``meta`` has ``image, width, height, n_bands, dtype`` and may have ``nodata,
    crs, affine, tags`` (a map) and ``name``, the file's name below ``path``,
    else ``{image}.tif``.  Blocks are whole rows or have sides that 16 divides.
    """
    blocks.sparkSession.dataSource.register(TiffSource)
    known = ["image", "width", "height", "n_bands", "dtype", "nodata", "crs", "affine", "tags", "name"]
    kept = meta.select(F.col("image").alias("__image"), F.struct(*[F.col("image").cast("string").alias("image") if c == "image" else F.col(c) for c in known if c in meta.columns]).alias("meta"))
    rows = blocks.join(kept, F.col("image") == F.col("__image")).select("image", "meta", "band", "row_off", "col_off", "h", "w", F.col("pixels").cast("array<double>").alias("pixels"))
    order = ["image", "band", "row_off", "col_off"]
    spark = blocks.sparkSession
    spark.dataSource.register(TiffSource)
    rows.repartition("image").sortWithinPartitions(*order).write.format("tessera_tiff").mode(mode).options(path=path, compress=compress).save()
