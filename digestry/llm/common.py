"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.session import ship_package, work_path

#: The characters that part words, as a Java character class and as plain characters.
SPACE = r"[ \t-\r]"
SPACES = " \t\n\x0b\x0c\r"
#: An Arrow batch of whole texts ends at this many bytes, so that long texts cannot fill a worker.
BATCH_BYTES = 32 << 20


def ready(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> SparkSession:
    """Make the package importable in Python workers and bound their batches by bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return spark


_REMEMBERED: dict[str, Any] = {}


def remembered(owner: str, make: Callable[[], Any] = dict) -> Any:
    """What an operator keeps in this Python worker from one task to the next.

    Only one operator keeps anything: workers serve many of them, and what each remembers must not add
    up. Another one's memory is given back before this one starts.
    """
    if owner not in _REMEMBERED:
        _REMEMBERED.clear()
        pa.default_memory_pool().release_unused()
        _REMEMBERED[owner] = make()
    return _REMEMBERED[owner]


def body(column: str | Column) -> Column:
    """A text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(build: Callable[[Column], Column], **values: Column) -> Column:
    """``build`` over a struct of ``values``, each of which is computed once for a row."""
    held = F.struct(*[value.alias(name) for name, value in values.items()])
    return F.get(F.transform(F.array(held), build), F.lit(0))


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts, F.lit(0))


def save(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; it goes when the session's JVM ends."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
