"""A log of numbered commits that are created only if absent.

A commit is one small JSON file, named by its number, that tells all of a state: readers take the highest
number and follow it, so they see one commit or the next and nothing between. A writer says which number it
read; the next number can be created once, so of two writers one loses and has to look at what the other did.

On a local file system the file is linked into place, elsewhere it is created by the store's own create-if-absent.
A store that overwrites silently is no place for a log.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class ConflictError(RuntimeError):
    """Another writer's commit changed what this one is about."""


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    where, at = _hadoop(spark, folder)
    return sorted(x.getPath().getName() for x in where.listStatus(at)) if where.exists(at) else []


def delete_folder(spark: SparkSession, folder: str) -> None:
    where, at = _hadoop(spark, folder)
    where.delete(at, True)


def read_small(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    where, at = _hadoop(spark, path)
    stream = where.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file as a whole; False, and nothing done, where it is there already."""
    where, at = _hadoop(spark, path)
    where.mkdirs(at.getParent())
    parsed = urlparse(where.makeQualified(at).toString())
    if parsed.scheme == "file":
        final = unquote(parsed.path)
        temporary = f"{os.path.dirname(final)}/.{uuid.uuid4().hex}"
        try:
            with open(temporary, "x", encoding="utf-8") as out:
                out.write(text)
                out.flush()
                os.fsync(out.fileno())
            os.link(temporary, final)
            return True
        except FileExistsError:
            return False
        finally:
            if os.path.exists(temporary):
                os.unlink(temporary)
    try:
        out = where.create(at, False)
    except Py4JJavaError as error:
        if where.exists(at):
            return False
        raise error
    out.write(bytearray(text.encode()))
    out.close()
    return True


class CommitLog:
    """Commits 1, 2, ... below a folder; 0 is the state before the first."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def numbers(self) -> list[int]:
        return [int(x[:-5]) for x in list_names(self.spark, self.folder) if x.endswith(".json") and x[:-5].isdigit()]

    def head(self) -> int:
        return max(self.numbers(), default=0)

    def read(self, number: int | None = None) -> dict:
        """A commit's state, the latest by default; {} for 0."""
        number = self.head() if number is None else number
        return json.loads(read_small(self.spark, self._path(number))) if number else {}

    def commit(self, base: int, state: dict) -> int:
        """Make `state` the commit after `base`, or fail where that is there."""
        body = json.dumps(state | {"number": base + 1, "base": base}, sort_keys=True, separators=(",", ":"))
        if not create_if_absent(self.spark, self._path(base + 1), body):
            raise ConflictError(f"commit {base + 1} is another writer's")
        return base + 1

    def update(self, change: Callable[[dict], dict], attempts: int = 20) -> int:
        """Commit change(latest state); where another writer was faster, again on what that one left.

        `change` raises ConflictError where that cannot be.
        """
        for _ in range(attempts):
            base = self.head()
            try:
                return self.commit(base, change(self.read(base)))
            except ConflictError:
                if self.head() == base:
                    raise
        raise ConflictError(f"no commit in {attempts} attempts")
