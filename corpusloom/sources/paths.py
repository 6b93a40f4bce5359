"""Files and folders of any file system that the session's Hadoop configuration knows: local disks, HDFS, object stores."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpusloom.session import session


def _of(path: str):
    """(file system, its path object) of a path; a path without a scheme is of the default file system."""
    spark = SparkSession.getActiveSession() or session()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def absolute(path: str) -> str:
    fs, place = _of(path)
    return fs.makeQualified(place).toString()


def exists(path: str) -> bool:
    fs, place = _of(path)
    return fs.exists(place)


def is_folder(path: str) -> bool:
    fs, place = _of(path)
    return fs.exists(place) and fs.getFileStatus(place).isDirectory()


def glob(folder: str, pattern: str, folders: bool = False) -> list[str]:
    """Sorted paths in a folder that match: files, and folders as well where data sets are folders of part files."""
    fs, place = _of(f"{folder}/{pattern}")
    found = fs.globStatus(place) or ()
    return sorted(s.getPath().toString().removeprefix("file:") for s in found if folders or s.isFile())


def listing(folder: str) -> list[str]:
    fs, place = _of(folder)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def make_folder(path: str) -> None:
    fs, place = _of(path)
    fs.mkdirs(place)


def remove(path: str) -> None:
    fs, place = _of(path)
    fs.delete(place, True)


def move(path: str, to: str) -> None:
    fs, place = _of(path)
    if not fs.rename(place, _of(to)[1]):
        raise OSError(f"{path} could not be moved to {to}")


def write_text(path: str, text: str) -> None:
    fs, place = _of(path)
    stream = fs.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(path: str) -> str:
    fs, place = _of(path)
    if not fs.exists(place):
        raise FileNotFoundError(path)
    stream = fs.open(place)
    try:
        utils = SparkSession.getActiveSession()._jvm.org.apache.commons.io.IOUtils
        return utils.toString(stream, "UTF-8")
    finally:
        stream.close()
