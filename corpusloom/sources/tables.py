"""Parquet scans of the project's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`; a file or a folder of Parquet files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of ids or small facts up to which a table is broadcast (about 16 MB); beyond, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's `spark.checkpoint.dir`.

    Where the session names none, a folder of our own, but only with a local
    master: on a cluster a folder of one machine would lose results with it, so
    that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or "/tmp/corpusloom-checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if a count of its rows says that it is small; `df` as it is otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder, its lineage cut there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: list = []


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a Parquet table to the checkpoint folder and read back: lineage
    cut like `cut`, with columns compressed and pruned. Deleted when the driver ends."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _STORED:
        import atexit

        atexit.register(_drop_stored)
    _STORED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _drop_stored() -> None:
    for spark, path in _STORED:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone; the folder then goes with the session's
            return
