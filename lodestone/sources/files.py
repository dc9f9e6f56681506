"""The few file-system calls the table layouts need, on any Hadoop file system."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_dir(spark: SparkSession, path: str) -> list[tuple[str, str, int, int]]:
    """``(name, full path, bytes, modified ms)`` of the entries; empty when absent."""
    fs, p = _open(spark, path)
    if not fs.exists(p):
        return []
    entries = fs.listStatus(p)
    return [(e.getPath().getName(), e.getPath().toString(), e.getLen(), e.getModificationTime()) for e in entries]


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _open(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, content: str | bytes) -> bool:
    """Create a file; False when it exists already.

    The content is written aside and renamed without overwriting, so a reader
    never meets half a file and of two writers only one succeeds.
    """
    fs, p = _open(spark, path)
    if fs.exists(p):
        return False
    hadoop = spark._jvm.org.apache.hadoop.fs
    aside = hadoop.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(content.encode() if isinstance(content, str) else content))
    finally:
        stream.close()
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = hadoop.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(aside, p, options)
    except Py4JJavaError as err:
        fs.delete(aside, False)
        if "FileAlreadyExists" in err.java_exception.getClass().getName():
            return False
        raise
    return True


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder within its file system to a path that does not exist yet."""
    fs, p = _open(spark, source)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"could not rename {source} to {target}")


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.delete(p, True)
