"""Small files and folders on whatever file system a path names (through Hadoop's API)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(conf), conf


def exists(spark: SparkSession, path: str) -> bool:
    p, fs, _ = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a folder, in order; none if there is no folder."""
    p, fs, _ = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs, _ = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file in one step: it is there whole or not at all.  False if it exists already.

    The text goes to a file of another name, which is renamed without overwriting; of two
    writers of one name the second is told so.
    """
    p, fs, conf = _at(spark, path)
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(draft, p, options)
    except Exception as e:  # noqa: BLE001  the Java class of the error says what it was
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    p, fs, _ = _at(spark, path)
    fs.delete(p, True)


def file_system(path: str):
    """(file system, path in it) for Python code in tasks, which has no Hadoop."""
    from pyarrow import fs

    if ":/" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def parts_for_tasks(spark: SparkSession, folder: str) -> list[str]:
    """The Parquet files of a written table, if tasks can open them without Spark; else none."""
    import pyarrow as pa

    try:
        file_system(folder)
    except (pa.ArrowException, ValueError, OSError):
        return []
    return [f"{folder}/{n}" for n in names(spark, folder) if n.endswith(".parquet")]
