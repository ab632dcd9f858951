"""Small text files in a shared folder that appear whole and only once.

:func:`publish` is the one primitive that concurrent writers agree through: of several that
publish the same name, exactly one succeeds, and a reader sees the whole text or no file.
Locally that is a hard link, elsewhere the file system's rename without overwrite (atomic on
HDFS and stores that offer it).  :class:`Sequence` numbers such files 0, 1, 2, ..., so the
newest one is a value that changes atomically and keeps its history.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _jvm(spark: SparkSession):
    return spark.sparkContext._jvm


def _fs(spark: SparkSession, path: str):
    p = _jvm(spark).org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """File names of a folder; a folder that is not there has none."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p)]


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    f = fs.open(p)
    try:
        return bytes(f.readAllBytes()).decode()
    finally:
        f.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """True if this call made the file, False if the name is taken."""
    jvm = _jvm(spark)
    fs, dst = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(dst.getParent(), f".{dst.getName()}.{uuid.uuid4().hex}")
    f = fs.create(tmp, False)
    f.write(bytearray(text.encode()))
    f.close()
    try:
        if fs.getUri().getScheme() == "file":
            link, made = (jvm.java.io.File(p.toUri().getPath()).toPath() for p in (dst, tmp))
            jvm.java.nio.file.Files.createLink(link, made)
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(tmp, dst, options)
    except Exception as e:  # noqa: BLE001 - py4j wraps whatever the file system throws
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(tmp, False)
    return True


class Sequence:
    """Numbered records ``<folder>/<kind>-0000000000``; each number is published once."""

    def __init__(self, spark: SparkSession, folder: str, kind: str):
        self.spark, self.folder, self.kind = spark, folder.rstrip("/"), kind

    def _path(self, n: int) -> str:
        return f"{self.folder}/{self.kind}-{n:010d}"

    def last(self) -> int:
        """The highest number, -1 if there is none."""
        mine = [x[len(self.kind) + 1:] for x in names(self.spark, self.folder) if x.startswith(f"{self.kind}-")]
        return max((int(x) for x in mine), default=-1)

    def read(self, n: int) -> dict:
        return json.loads(read_text(self.spark, self._path(n)))

    def has(self, n: int) -> bool:
        return exists(self.spark, self._path(n))

    def offer(self, n: int, record: dict) -> bool:
        return publish(self.spark, self._path(n), json.dumps(record))
