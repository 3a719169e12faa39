"""Folders that are replaced as a whole: a new version is written beside the current one, checked, and then named by one small file.

Until that file is switched, readers have the old version, whatever happens to the write. Names of unfinished versions
start with an underscore, so that Spark's own readers don't see them either.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

POINTER = "_current"


def _at(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, in any store that Spark reaches."""
    to, fs = _at(spark, path)
    out = fs.create(to, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def current(spark: SparkSession, path: str) -> str:
    """The folder that holds a path's current version: the path itself where nothing was replaced by ``replace``."""
    at, fs = _at(spark, f"{path.rstrip('/')}/{POINTER}")
    if any(c in path for c in "*?{[") or not fs.exists(at):
        return path
    source = fs.open(at)
    try:
        return f"{path.rstrip('/')}/{spark._jvm.org.apache.commons.io.IOUtils.toString(source, 'UTF-8')}"
    finally:
        source.close()


def replace(spark: SparkSession, path: str, write: Callable[[str], object], check: Callable[[str], object] | None = None) -> None:
    """Write a folder's next version by ``write(folder)``, let ``check(folder)`` raise if it is not right, and make it the current one.

    A write or check that fails leaves the current version as it is, and its own rows are removed; those of a driver that died
    are removed by the next call. Older versions go once the new one is named, plain files of the folder too.
    """
    root = path.rstrip("/")
    name = f"version-{uuid.uuid4().hex}"
    new = f"{root}/_new-{name}"
    try:
        write(new)
        if check is not None:
            check(new)
    except BaseException:
        at, fs = _at(spark, new)
        fs.delete(at, True)
        raise
    at, fs = _at(spark, new)
    to, _ = _at(spark, f"{root}/{name}")
    if not fs.rename(at, to):
        raise OSError(f"{new} can't be renamed")
    # the pointer is written aside and renamed over the old one, which a file system does at once or not at all
    write_text(spark, f"{root}/_next-{name}", name)
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(_at(spark, f"{root}/_next-{name}")[0], _at(spark, f"{root}/{POINTER}")[0], options)
    for f in fs.listStatus(_at(spark, root)[0]):
        if f.getPath().getName() not in (name, POINTER):
            fs.delete(f.getPath(), True)
