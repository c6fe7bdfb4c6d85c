"""Byte access to files wherever pyarrow can open them (local, HDFS, object stores)."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import pyarrow.fs as fs
from pyspark.sql import SparkSession


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def open_bytes(path: str):
    """A seekable file of bytes."""
    system, name = _at(path)
    return system.open_input_file(name)


def exists(path: str) -> bool:
    system, name = _at(path)
    return system.get_file_info(name).type == fs.FileType.File


def size(path: str) -> int:
    system, name = _at(path)
    return system.get_file_info(name).size


def create(path: str):
    system, name = _at(path)
    return system.open_output_stream(name)


def remove(path: str) -> None:
    system, name = _at(path)
    system.delete_file(name)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that all executors can read: in that of spark.checkpoint.dir, else, in local mode alone, a temporary one. It goes when the driver ends."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix=f"{tag}-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        return path
    path = f"{top.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    system, name = _at(path)
    system.create_dir(name, recursive=True)
    atexit.register(system.delete_dir, name)
    return path
