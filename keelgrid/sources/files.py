"""Byte ranges of files, and folders that all executors see, where Spark's addresses point, through pyarrow's file systems."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for an address (a plain path, file, hdfs, s3, gs), and the path in it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return pafs.LocalFileSystem(), "/" + (rest if scheme == "file" else uri).lstrip("/")
    return pafs.FileSystem.from_uri("s3:" + rest if scheme in ("s3a", "s3n") else uri)


def read_range(uri: str, first: int, size: int) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(size, first)


def file_size(uri: str) -> int:
    fs, path = filesystem(uri)
    info = fs.get_file_info(path)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(uri)
    return info.size


def exists(uri: str) -> bool:
    fs, path = filesystem(uri)
    return fs.get_file_info(path).type == pafs.FileType.File


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors see; it goes when the session ends.

    Where that is unset a local master gets a temporary folder, which is then set; another gets an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="keelgrid-")
        spark.sparkContext.setCheckpointDir(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root, f"{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()
