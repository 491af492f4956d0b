"""Small files and whole tables on any file system that Spark writes to: text in and out, a listing with sizes, and a table swapped for another."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class SwapFailed(RuntimeError):
    """A table could not be swapped; the old one is where it was."""


class Store:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def rename(self, source: str, target: str) -> None:
        if self.exists(target) or not self._fs.rename(self._at(source), self._at(target)):
            raise OSError(f"{source} could not be renamed to {target}")

    def remove(self, path: str) -> None:
        self._fs.delete(self._at(path), True)

    def make_folder(self, path: str) -> None:
        self._fs.mkdirs(self._at(path))

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._at(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """The whole file at once: beside it first, then in its place, so that a reader never sees half of it."""
        beside = f"{path}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(beside), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        self._fs.delete(self._at(path), False)
        self.rename(beside, path)

    def names(self, folder: str) -> list[tuple[str, int, bool]]:
        """(name, bytes of all files in it, whether it is a folder), in order of names; none where the folder is absent."""
        if not self.exists(folder):
            return []
        found = [(s.getPath().getName(), self._fs.getContentSummary(s.getPath()).getLength(), s.isDirectory()) for s in self._fs.listStatus(self._at(folder))]
        return sorted(found)

    def fingerprint(self, path: str) -> str:
        """A hash of the names, sizes and times of all files under a path: it changes when an input does."""
        seen = []
        files = self._fs.listFiles(self._at(path), True)
        while files.hasNext():
            s = files.next()
            seen.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()


def backups(spark: SparkSession, path: str) -> list[str]:
    """The numbered backups of a table, oldest first."""
    folder, _, name = path.rstrip("/").rpartition("/")
    pattern = re.compile(re.escape(name) + r"\.backup-(\d+)")
    return [f"{folder}/{n}" for n, _, _ in Store(spark, path).names(folder) if pattern.fullmatch(n)]


def replace_table(df: DataFrame, path: str, fmt: str = "parquet", keep: int = 5) -> str | None:
    """Writes df in the place of the table at path, which stays beside it as a numbered backup; returns the backup's path, None where there was no table.

    The new table is written whole before the old one is touched, so df may read the old one. If a step fails, what was moved goes back and the old table is
    whole; a run that died between the steps is put right by recover(). The last `keep` backups stay.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    store = Store(spark, path)
    recover(spark, path)
    beside = f"{path}.new-{uuid.uuid4().hex}"
    try:
        df.write.format(fmt).option("header", True).save(beside)
        old = None
        if store.exists(path):
            last = backups(spark, path)
            number = int(last[-1].rpartition("-")[2]) + 1 if last else 1
            old = f"{path}.backup-{number:06d}"
            store.rename(path, old)
        try:
            store.rename(beside, path)
        except Exception:
            if old:
                store.rename(old, path)
            raise
    except Exception as e:
        store.remove(beside)
        raise SwapFailed(f"{path} was not replaced: {e}") from e
    for gone in backups(spark, path)[:-keep]:
        store.remove(gone)
    return old


def recover(spark: SparkSession, path: str) -> bool:
    """Puts the last backup back where a run died after moving the table away; says whether it did. New tables that were never swapped in go."""
    path = path.rstrip("/")
    store = Store(spark, path)
    folder, _, name = path.rpartition("/")
    for n, _, _ in store.names(folder):
        if n.startswith(f"{name}.new-"):
            store.remove(f"{folder}/{n}")
    kept = backups(spark, path)
    if store.exists(path) or not kept:
        return False
    store.rename(kept[-1], path)
    return True
