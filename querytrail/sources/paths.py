"""Folder checks on whatever file system the path belongs to."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a Spark write to the folder has been committed."""
    return exists(spark, f"{path}/_SUCCESS")


def subfolders(spark: SparkSession, path: str) -> list[str]:
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory())


def make_folder(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.mkdirs(jpath)


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def delete_all(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders, several at a time: each is a call to the file system and a wait."""
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda p: delete(spark, p), paths))


def delete_if_empty(spark: SparkSession, path: str) -> None:
    """Delete a folder unless something is in it, or comes into it meanwhile."""
    fs, jpath = _fs(spark, path)
    if fs.exists(jpath) and not len(fs.listStatus(jpath)):
        try:
            fs.delete(jpath, False)
        except Py4JJavaError:  # no longer empty
            pass
