"""Small files on any file system that Spark reaches, read and written by the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _path(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    fs, at = _path(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def identities(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """Path, size and time of change of files, in order of path; one listing a folder, however many files it has."""
    folders: dict[str, dict[str, tuple[int, int]]] = {}
    out = []
    for path in sorted(paths):
        fs, at = _path(spark, path)
        folder = at.getParent().toString()
        if folder not in folders:
            folders[folder] = {s.getPath().getName(): (s.getLen(), s.getModificationTime()) for s in fs.listStatus(at.getParent())}
        out.append((path, *folders[folder].get(at.getName(), (-1, -1))))
    return out
