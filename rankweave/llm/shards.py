"""Sorted arrays that Spark tasks write as files of a shared folder and workers map into memory.

A file belongs to one shard and is written under a name of its own, then moved
to its place: a task that runs twice, or on another executor after a loss,
leaves the same file. On a file system that workers see as paths they map the
files where they lie; from any other one (pyarrow.fs must know it) a worker
copies a shard's file to its own temporary folder before it maps it. A shard
that isn't there raises an error, so nothing is missed in silence.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from rankweave.llm.scratch import new_path

SCHEMES = {"s3a": "s3", "s3n": "s3"}  # names that Hadoop and pyarrow have for one store


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + ":" + rest)


def new_folder(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new folder below the shared one, or the given one."""
    uri = folder or new_path(spark, name)
    system, path = _opened(uri)
    system.create_dir(path)
    return uri


def save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write arrays as name.0.npy and so on."""
    system, path = _opened(folder)
    for i, array in enumerate(arrays):
        part, whole = f"{path}/{name}.{i}.{uuid.uuid4().hex}.part", f"{path}/{name}.{i}.npy"
        with pa.PythonFile(system.open_output_stream(part), mode="w") as file:
            np.lib.format.write_array(_Writer(file), np.ascontiguousarray(array), allow_pickle=False)
        if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(whole).type != fs.FileType.NotFound:
            system.delete_file(part)
        else:
            system.move(part, whole)


class _Writer:
    """What numpy needs of a file to write to it in pieces."""

    def __init__(self, file: pa.PythonFile):
        self.write = lambda data: file.write(bytes(data))


@lru_cache(maxsize=1)
def _own_folder() -> str:
    made = tempfile.mkdtemp(prefix="spark-shards-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


@lru_cache(maxsize=4096)
def load(folder: str, name: str, parts: int) -> tuple[np.ndarray, ...]:
    """The arrays of a shard, mapped."""
    system, path = _opened(folder)
    found = []
    for i in range(parts):
        at = f"{path}/{name}.{i}.npy"
        if system.get_file_info(at).type == fs.FileType.NotFound:
            raise FileNotFoundError(f"{at} is not here: every worker must reach the folder {folder}")
        if not isinstance(system, fs.LocalFileSystem):
            copy = os.path.join(_own_folder(), f"{uuid.uuid4().hex}.npy")
            with system.open_input_stream(at) as source, open(copy, "wb") as target:
                shutil.copyfileobj(source, target, 1 << 22)
            at = copy
        array = np.load(at, mmap_mode="r")
        found.append(array if array.size else np.array(array))
    return tuple(found)
