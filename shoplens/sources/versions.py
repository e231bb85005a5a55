"""Versions of a published dataset: a change becomes visible by one commit record.

Tables are written to folders that nothing refers to yet; a small JSON record
under ``<root>/_commits`` then names the folders of all tables. Records are
numbered and created exclusively: readers take the highest complete one, so
they never see half of a change, and of two writers that start from the same
version one fails. A writer that dies leaves the last version as it was.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class ConcurrentChange(RuntimeError):
    """Another writer committed the version that this one wanted to commit."""


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def new_folder(root: str) -> str:
    """A folder for the next version's files."""
    return f"{root}/_versions/{uuid.uuid4().hex}"


def latest(spark: SparkSession, root: str) -> dict | None:
    """The newest complete record, or None where nothing was committed."""
    fs, folder = _file_system(spark, f"{root}/_commits")
    if not fs.exists(folder):
        return None
    names = sorted((s.getPath().getName() for s in fs.listStatus(folder)), reverse=True)
    for name in names:
        if not name.endswith(".json"):
            continue
        try:
            lines = spark.read.text(f"{root}/_commits/{name}", wholetext=True).collect()
            return json.loads(lines[0][0])
        except (IndexError, ValueError, AnalysisException):  # still being written, or its writer died
            continue
    return None


def _highest(spark: SparkSession, root: str) -> int:
    fs, folder = _file_system(spark, f"{root}/_commits")
    if not fs.exists(folder):
        return 0
    return max((int(n[:-5]) for s in fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json")), default=0)


def commit(spark: SparkSession, root: str, record: dict, after: int | None = None) -> dict:
    """Make ``record`` the newest version. ``after``: the version it was made from; a newer one is an error."""
    number = _highest(spark, root) + 1
    if after is not None and (latest(spark, root) or {"version": 0})["version"] != after:
        raise ConcurrentChange(f"{root}: version {after} is no longer the newest")
    record = record | {"version": number}
    fs, path = _file_system(spark, f"{root}/_commits/{number:020d}.json")
    from py4j.protocol import Py4JJavaError

    try:
        out = fs.create(path, False)
    except Py4JJavaError as taken:
        raise ConcurrentChange(f"{root}: version {number} was committed by another writer") from taken
    try:
        out.write(json.dumps(record).encode())
    finally:
        out.close()
    return record


def source_version(df: DataFrame) -> str:
    """A digest of the files that ``df`` scans: their names and their size together.

    Spark's writers never reuse a file name, so new, removed and rewritten
    files all change it. Names and sizes come from the scan's own listing.
    """
    size = str(df._jdf.queryExecution().analyzed().stats().sizeInBytes())
    names = sorted(f.rsplit("/", 1)[-1] for f in df.inputFiles())
    return hashlib.sha1("\n".join([size, *names]).encode()).hexdigest()
