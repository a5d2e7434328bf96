"""Whole files written from tasks to a store that every node reaches."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def put(uri: str, data: bytes) -> None:
    """Write ``data`` to ``uri`` so that a reader sees all of it or nothing.

    The bytes go to a hidden name first, which Spark's readers ignore, and are
    renamed when complete: a repeated or lost attempt leaves no torn file.
    """
    fs, path = pafs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    tmp = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as out:
        out.write(data)
    fs.move(tmp, path)
