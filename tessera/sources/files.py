"""Files by name: listings that say what can't be read, and one file a row written with a commit.

Both are Python data sources.  A listing is planned as one task for each folder
below the top (or each given path) and walked there; the driver sees only the
first level.  A writer's tasks put files into a folder of their own attempt,
and the commit moves those of the attempts that counted to their place, so a
failed task or job leaves nothing there; a task that outlives its job's abort
may leave files below ``_staged`` alone.  Paths are local or URIs of a store
that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

LISTED = "path string, name string, length long, status string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


# ------------------------------------------------------------------- listing


@dataclass
class Folder(InputPartition):
    """A folder to walk, one to look at without going deeper, or a single path."""

    path: str
    deep: bool


class _Walk(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.patterns = options.get("pattern", "*").split("|")
        self.recursive = options.get("recursive", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.paths:
            out.append(Folder(p, False))
            system, at = opened(p)
            if self.recursive and system.get_file_info(at).type == fs.FileType.Directory:
                below = system.get_file_info(fs.FileSelector(at))
                out += [Folder(f"{p.rstrip('/')}/{f.base_name}", True) for f in below if f.type == fs.FileType.Directory]
        return out

    def read(self, partition: Folder) -> Iterator[tuple]:
        system, at = opened(partition.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            yield partition.path, partition.path.rsplit("/", 1)[-1], None, "missing"
        elif info.type == fs.FileType.File:
            yield self._row(partition.path, info)
        else:
            for f in system.get_file_info(fs.FileSelector(at, recursive=partition.deep)):
                if f.type == fs.FileType.File and any(fnmatch.fnmatchcase(f.base_name, k) for k in self.patterns):
                    yield self._row(partition.path.rstrip("/") + f.path[len(at.rstrip("/")) :], f)

    @staticmethod
    def _row(path: str, info: fs.FileInfo) -> tuple:
        return path, info.base_name, info.size, "ok" if info.size else "empty"


class ListingSource(DataSource):
    """Format ``tessera_listing``: ``path, name, length, status``; status is ok, empty or missing."""

    @classmethod
    def name(cls) -> str:
        return "tessera_listing"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return _Walk(self.options)


def listing(spark: SparkSession, paths: str | list[str], pattern: str | list[str] = "*", recursive: bool = False) -> DataFrame:
    """Files at or below ``paths`` whose names match a pattern; contents aren't read.

    A path that isn't there is a row of status ``missing``, a file without
    bytes one of status ``empty``.
    """
    spark.dataSource.register(ListingSource)
    many = [paths] if isinstance(paths, str) else list(paths)
    patterns = pattern if isinstance(pattern, str) else "|".join(pattern)
    return spark.read.format("tessera_listing").options(paths="\n".join(many), pattern=patterns, recursive=str(recursive).lower()).load()


def first_file(spark: SparkSession, path: str, pattern: str = "*.tif") -> str | None:
    """The first name in a folder that matches, found by one task that lists that folder alone."""
    found = listing(spark, path, pattern).where("status <> 'missing'").selectExpr("min(path) AS path").first()
    return found["path"]


# ------------------------------------------------------------------- writing


@dataclass
class Staged(WriterCommitMessage):
    """Files of one task's attempt, to be moved to their names."""

    folder: str
    names: list[str]


class StagedWriter(DataSourceArrowWriter):
    """Tasks write below ``_staged``; the commit publishes what counted and removes the rest."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = uuid.uuid4().hex

    def put(self, batches: Iterator[pa.RecordBatch], folder: str, system: fs.FileSystem) -> list[str]:
        """Write a task's files into ``folder``; their names."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, root = opened(self.path)
        folder = f"{root}/_staged/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        return Staged(folder, self.put(iterator, folder, system))

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = opened(self.path)
        names = [(m.folder, n) for m in messages if m for n in m.names]
        if len({n for _, n in names}) < len(names):
            self.abort(messages)
            raise ValueError("several rows name the same file")
        if self.overwrite and system.get_file_info(root).type == fs.FileType.Directory:
            keep = {n for _, n in names}
            for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
                name = f.path[len(root) + 1 :]
                if f.type == fs.FileType.File and not name.startswith("_staged/") and name not in keep:
                    system.delete_file(f.path)
        for folder, name in names:
            if "/" in name:
                system.create_dir(f"{root}/{name.rsplit('/', 1)[0]}", recursive=True)
            system.move(f"{folder}/{name}", f"{root}/{name}")
        self._clear(system, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_staged/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_staged/{self.job}")
        staged = f"{root}/_staged"
        if system.get_file_info(staged).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(staged)):
            system.delete_dir(staged)


class _TextWriter(StagedWriter):
    def put(self, batches: Iterator[pa.RecordBatch], folder: str, system: fs.FileSystem) -> list[str]:
        names = []
        for b in batches:
            for name, value in zip(b.column("name").to_pylist(), b.column("value").to_pylist(), strict=True):
                if not name or name.startswith(("/", "_staged/")) or ".." in name.split("/"):
                    raise ValueError(f"not a file name: {name}")
                if "/" in name:
                    system.create_dir(f"{folder}/{name.rsplit('/', 1)[0]}", recursive=True)
                with system.open_output_stream(f"{folder}/{name}") as f:
                    f.write((value or "").encode())
                names.append(name)
        return names


class TextFilesSource(DataSource):
    """Format ``tessera_files``: writes each row ``name, value`` as a file of that name below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "tessera_files"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _TextWriter(self.options["path"], overwrite)


def write_text_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write ``name, value`` as one file a row.

    A name that exists is replaced; other files stay, unless ``mode`` is
    ``overwrite``.  Two rows of one name are an error, and then nothing is
    published.
    """
    rows.sparkSession.dataSource.register(TextFilesSource)
    rows.select("name", "value").write.format("tessera_files").mode(mode).option("path", path).save()
