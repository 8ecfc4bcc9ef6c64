"""Small files of a shared folder, through Hadoop's file system API.

Only names and a few kilobytes of text pass through here: pointers, commit
records, folder listings. Data files are read and written by Spark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names directly below a folder; none if it doesn't exist."""
    if not exists(spark, folder):
        return []
    return sorted(s.getPath().getName() for s in _fs(spark, folder).listStatus(_path(spark, folder)))


def modified(spark: SparkSession, path: str) -> tuple[int, int]:
    """Newest modification time (milliseconds) and total length of a file or of
    the files directly below a folder."""
    status = _fs(spark, path).listStatus(_path(spark, path))
    return max((s.getModificationTime() for s in status), default=0), sum(s.getLen() for s in status)


def read_text(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that doesn't exist yet, whole or not at all. False, and
    nothing changed, if it exists by the time the text has been written."""
    hidden = path.rsplit("/", 1)
    aside = f"{hidden[0]}/.{hidden[1]}-{uuid.uuid4().hex}"
    out = _fs(spark, path).create(_path(spark, aside), True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _fs(spark, path).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    no_overwrite = spark.sparkContext._gateway.new_array(kind, 1)
    no_overwrite[0] = getattr(kind, "NONE")
    try:
        context.rename(_path(spark, aside), _path(spark, path), no_overwrite)
    except Exception as e:
        delete(spark, aside)
        if "FileAlreadyExists" in str(e) or exists(spark, path):
            return False
        raise
    return True


def move_into(spark: SparkSession, folder: str, into: str, prefix: str) -> int:
    """Move the data files directly below ``folder`` into another folder of the
    same file system, where each appears whole, its name behind ``prefix`` (a task
    gives its files of several folders one name); the number moved, 0 if there are none."""
    fs = _fs(spark, into)
    fs.mkdirs(_path(spark, into))
    found = [n for n in names(spark, folder) if not n.startswith(("_", "."))]
    for n in found:
        if not fs.rename(_path(spark, f"{folder}/{n}"), _path(spark, f"{into}/{prefix}{n}")):
            raise OSError(f"{folder}/{n} could not be moved into {into}")
    return len(found)


def delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)
