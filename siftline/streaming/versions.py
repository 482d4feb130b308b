"""Small tables that change while they are read: whole versions, and a pointer to the current one.

A version is a parquet folder of its own; the pointer is a file that is replaced by a rename once the version is
complete. Readers follow the pointer once and so see one version. The last few versions stay for those still reading.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

KEPT = 3
_POINTER = "current"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the current version."""
    jvm, pointer, fs = _hadoop(spark, f"{path}/{_POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return stream.readLine()
    finally:
        stream.close()


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current version; without one, no rows."""
    name = current(spark, path)
    if name is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def publish(table: DataFrame, path: str, number: int) -> None:
    """Write ``table`` as a new version and make it the current one. One writer at a time."""
    spark = table.sparkSession
    name = f"version-{number:012d}-{uuid.uuid4().hex}"
    before = current(spark, path)
    table.coalesce(1).write.parquet(f"{path}/{name}")
    jvm, pointer, fs = _hadoop(spark, f"{path}/{_POINTER}")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/_{name}.pointer")
    stream = fs.create(fresh, True)
    stream.writeBytes(name + "\n")
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fresh), fs.makeQualified(pointer), how)
    folders = [f.getPath() for f in fs.listStatus(pointer.getParent()) if f.isDirectory()]
    old = sorted((p for p in folders if p.getName() not in (name, before)), key=lambda p: p.getName())
    for folder in old[: max(0, len(folders) - KEPT)]:
        fs.delete(folder, True)
