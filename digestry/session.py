"""Session defaults and the shared folder that durable intermediate data goes to."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build_session(name: str = "digestry", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one in the warehouse, which
    the driver and all executors share as well."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    return (configured or f"{warehouse.rstrip('/')}/_intermediate").rstrip("/")


def _gone_at_exit(spark: SparkSession, path: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; it is removed when the session's JVM ends."""
    return _gone_at_exit(spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut the lineage with a written table, so lost executors cannot change the rows.

    Catalyst then knows its size in bytes: a join broadcasts it below the session's threshold.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt to as many tasks as the session shuffles to, by a hash of ``columns``. Only rows that are
    equal in all of them are sure to meet, so repeated or null keys make no large task."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *columns)


def drop_stored(df: DataFrame) -> None:
    """Remove the files of a table that ``stored`` has written and nobody reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        remove(df.sparkSession, folder)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="digestry-ship-")) / root.name
    archive = shutil.make_archive(str(target), "zip", root.parent, root.name)
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
