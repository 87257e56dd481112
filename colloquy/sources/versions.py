"""Stored tables in versions: a reader meets a whole one, a writer's work counts once.

A table is a folder with ``data/`` (a folder of Parquet files for each commit) and ``versions/`` (a small JSON manifest each, numbered
from 1). A commit writes its rows in full, then its manifest under another name, and moves that to the next number: this one
rename makes it current. It fails if the number is taken, so of two writers that read the same version one is refused. A
manifest also says which batch of which stream it holds, hence a batch that comes again after a failure changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has made the version that a commit was to make."""


@dataclass(frozen=True)
class Version:
    """One state of a table: its number, where its rows are, and the last batch of each stream that it holds."""

    number: int
    data: str
    schema: str
    rows: int
    batches: dict[str, int] = field(default_factory=dict)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    jvm, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(configuration)


def _names(spark: SparkSession, path: str) -> list[int]:
    _, place, system = _hadoop(spark, f"{path}/versions")
    if not system.exists(place):
        return []
    names = [s.getPath().getName() for s in system.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())


def history(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all versions that can be read."""
    return _names(spark, path.rstrip("/"))


def current(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The latest version, or the one asked for; None where there is none."""
    path = path.rstrip("/")
    numbers = _names(spark, path)
    if number is None:
        number = numbers[-1] if numbers else None
    if number not in numbers:
        return None
    text = spark.read.text(f"{path}/versions/{number:012d}.json", wholetext=True).first()[0]
    return Version(**json.loads(text))


def rows_of(spark: SparkSession, path: str, version: Version) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(version.schema))).parquet(f"{path.rstrip('/')}/{version.data}")


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of the latest version, or of the one asked for."""
    version = current(spark, path, number)
    if version is None:
        raise FileNotFoundError(f"{path} has no version {number or ''}".rstrip())
    return rows_of(spark, path, version)


def commit(rows: DataFrame, path: str, expected: int | None = None, batch: tuple[str, int] | None = None) -> Version:
    """Makes ``rows`` the next version, after the one ``expected`` (0 for the first) or, where that is not said, the latest.

    ``batch`` is the stream's name and the batch's number; those of other streams are kept.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    before = current(spark, path)
    base = before.number if before else 0
    if expected is not None and expected != base:
        raise Conflict(f"{path} is at version {base}, not {expected}")
    name = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/{name}")
    batches = (before.batches if before else {}) | ({batch[0]: batch[1]} if batch else {})
    version = Version(base + 1, name, rows.schema.json(), written.count(), batches)
    jvm, staged, system = _hadoop(spark, f"{path}/versions/_{uuid.uuid4().hex}")
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{version.number:012d}.json")
    stream = system.create(staged, False)
    stream.write(bytearray(json.dumps(asdict(version)).encode()))
    stream.close()
    if system.exists(target) or not system.rename(staged, target):
        system.delete(staged, False)
        raise Conflict(f"{path} has version {version.number} already")
    return version


def trimmed(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes all but the last versions, manifests before the data that they name; readers of older ones must be done."""
    path = path.rstrip("/")
    for number in history(spark, path)[: -max(keep, 1)]:
        version = current(spark, path, number)
        for name in (f"versions/{number:012d}.json", version.data):
            _, place, system = _hadoop(spark, f"{path}/{name}")
            system.delete(place, True)


def once(path: str, stream: str, change: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch changes the table once, however often it comes.

    ``change`` makes the new rows from those there are (None before the first) and the batch's.
    """

    def apply(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        version = current(spark, path)
        if version and version.batches.get(stream, -1) >= number:
            return
        before = rows_of(spark, path, version) if version else None
        commit(change(before, rows), path, version.number if version else 0, (stream, number))

    return apply
