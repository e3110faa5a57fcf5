"""Arrow functions on executors, with this package sent along."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from foliant.storage import parts_of

_SENT = "_foliant_sent"
#: Bytes of an Arrow batch sent to a Python worker, unless the session says otherwise.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that their workers can import it.

    Batches for Python workers are bounded by bytes where the session sets no bound of its own.
    """
    if spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, _SENT, None):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="foliant-")) / "foliant.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    setattr(context, _SENT, str(archive))


def ship_to_driver(spark: SparkSession) -> None:
    """Let Python processes that Spark starts beside the driver, as for stateful streams, import this package too."""
    ship(spark)
    context = spark.sparkContext
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if getattr(context, _SENT) not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([getattr(context, _SENT), *paths])


def spread(df: DataFrame, per: int = 1 << 20) -> DataFrame:
    """``df`` dealt over parts of about ``per`` bytes, two a core at least, for steps that work long on each row.

    A scan is cut by bytes as stored, so short rows by the million would come in one part.
    """
    return df.repartition(parts_of(df, per) or 2 * df.sparkSession.sparkContext.defaultParallelism)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand on every executor."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
