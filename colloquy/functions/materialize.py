"""Cutting lineage in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset a temporary one, but only on a local master."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="colloquy-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and reread from reliable checkpoint files; for narrow rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once and reread from a Parquet table in the shared folder; for wide rows, which it compresses."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collected(frames: Iterable[DataFrame], name: str) -> DataFrame:
    """All rows of ``frames`` (at least one, of one schema), each computed once into one Parquet table in the shared folder."""
    path = None
    for df in frames:
        path = path or f"{_tables(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders, below the application's, of what is being made now.
_scopes: list[str] = []


def scoped(make: Callable[[], DataFrame], spark: SparkSession) -> tuple[DataFrame, str]:
    """What ``make`` gives, and the folder of the tables that were written for it, which it may still read."""
    scope = uuid.uuid4().hex
    _scopes.append(scope)
    try:
        return make(), _tables(spark)
    finally:
        _scopes.remove(scope)


def settled(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> tuple[DataFrame, str]:
    """What ``make`` gives, as a table of its own, and its folder; the tables that were written for it are deleted."""
    df, inside = scoped(make, spark)
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    dropped(spark, inside)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _tables(spark: SparkSession) -> str:
    return "/".join([f"{shared_dir(spark)}/colloquy-{spark.sparkContext.applicationId}", *_scopes])


def clear(spark: SparkSession) -> None:
    """Deletes all tables and checkpoints of this application; results that were not stored elsewhere can no longer be read.

    Nothing does so by itself: a result may be read at any later time. For a next run, checkpoints go to a new folder.
    """
    context = spark.sparkContext
    folder = shared_dir(spark)
    for path in (_tables(spark), folder):
        dropped(spark, path)
    context.setCheckpointDir(folder.rsplit("/", 1)[0])
