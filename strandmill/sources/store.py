"""Folders and small files on the file system that Spark reads, wherever that is."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, label: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which driver and executors share; it is cleared when the interpreter ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")  # one machine, as in tests
        spark.sparkContext.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_clear, spark, folder)
    return folder


def _clear(spark: SparkSession, folder: str) -> None:
    try:
        delete(spark, folder)
    except Exception:  # the session may be gone when the interpreter ends
        return


def scratch(spark: SparkSession, label: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a table below a new shared folder and reads it back: a lost executor costs its tasks, not the lineage."""
    folder = shared(spark, label)

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return save


def key(text: str) -> str:
    """A short name for a text, the same in every session."""
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names within a folder, none if it isn't there."""
    fs, target = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _at(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there whole or not at all."""
    fs, target = _at(spark, path)
    _, part = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} couldn't be put in place")
