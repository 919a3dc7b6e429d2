"""Files of Python workers in the shared folder, on any file system that Arrow knows by its scheme (file, s3, gs, abfs, hdfs)."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def writer(uri: str):  # noqa: ANN201
    """A stream that makes the file and the folders before it. On object stores the file is there once the stream closes."""
    fs, path = opened(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    return fs.open_output_stream(path, compression=None)


@contextmanager
def whole(uri: str):  # noqa: ANN201
    """A stream whose file is there under its name once it is closed without an error, and not before. Each attempt of a task writes under a name of its own, so one that is killed leaves what another has
    finished as it is; attempts that both end leave one of their files, which hold the same."""
    fs, path = opened(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as f:
        yield f
    try:
        fs.move(own, path)
    except OSError:
        if fs.get_file_info(path).type != pafs.FileType.File:
            raise
        fs.delete_file(own)  # file systems that don't replace a file keep the first one


def reader(uri: str):  # noqa: ANN201
    fs, path = opened(uri)
    return fs.open_input_stream(path, compression=None)


def local(uri: str) -> str | None:
    """A path that can be memory-mapped, or None if there is no such file: the file itself where the folder is mounted, else a copy in the folder that Spark keeps for its executor's files."""
    fs, path = opened(uri)
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    if isinstance(fs, pafs.LocalFileSystem):
        return path
    from pyspark import SparkFiles

    own = os.path.join(SparkFiles.getRootDirectory(), path.strip("/").replace("/", "_"))
    if not os.path.exists(own):
        part = f"{own}.{os.getpid()}"
        pafs.copy_files(path, part, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
        os.replace(part, own)  # whole or not at all
    return own
