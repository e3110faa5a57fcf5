"""Shared storage for intermediate tables.

Intermediate results that cut lineage are written below the folder that the cluster names in
``spark.checkpoint.dir``; every executor reads them back from there, so a lost executor costs a
retry and never the result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark drops the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of input, as stored, for one file of an intermediate table.
PART_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder: of ``spark.checkpoint.dir``, else of the context.

    A temporary one is set only in local mode (tests); a cluster without one is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = known.get() if known.isDefined() else None
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="foliant-checkpoint-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def parts_for(spark: SparkSession, size: int, per: int = PART_BYTES) -> int:
    """Files for a result of ``size`` bytes: two for each core at least, so that none of them waits."""
    return max(1 + size // per, 2 * spark.sparkContext.defaultParallelism)


def parts_of(df: DataFrame, per: int = PART_BYTES) -> int | None:
    """Files that a result in proportion to ``df`` should have, by Spark's estimate of its size; None without one."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if size >> 50 else parts_for(df.sparkSession, size, per)


def materialize(df: DataFrame, name: str, *done: DataFrame, parts: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, in at most ``parts`` files.

    Its shuffles are dropped when it is written. ``done`` are results of this function that nothing
    reads any more; their folders go then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df = df if parts is None else df.coalesce(parts)
    with setting(spark, _CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    discard(*done)
    result = spark.read.schema(df.schema).parquet(path)
    result._foliant_path = path
    return result


def discard(*frames: DataFrame) -> None:
    """Delete the folders of results of ``materialize`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_foliant_path", None)
        if path:
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)
