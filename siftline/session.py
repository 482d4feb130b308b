"""Session settings and the shared working folder used by the operators."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    # JSON lines may repeat a key; the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Timestamps are wall clocks; a fixed zone keeps text rendering stable.
    "spark.sql.session.timeZone": "UTC",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on. Safe to call repeatedly."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def pin_split_layout(spark: SparkSession) -> int:
    """Fix the lower bound on scan splits so that two scans of the same files agree.

    Spark derives the split size from the number of cores known at planning
    time, which can change while executors come and go. Line numbering scans
    the same files twice and needs the same splits both times.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(max(1, spark.sparkContext.defaultParallelism)))
    return int(spark.conf.get(key))


#: Folders of single-process sessions without the setting, by application.
_own_folders: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor must reach.

    A session that runs in one process (``local`` or ``local[n]``) and does not set it gets a folder of its own, which
    goes when Python ends. Any other session must set it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="siftline-")
        atexit.register(shutil.rmtree, _own_folders[application], ignore_errors=True)
    return _own_folders[application]


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in a folder of this application."""
    return f"{shared_root(spark)}/siftline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> None:
    """Delete all that this application has staged; results that read it can't be computed again afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        f"{shared_root(spark)}/siftline-{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Folders staged by each application, in order.
_staged: dict[str, list[str]] = {}


def staged_so_far(spark: SparkSession) -> int:
    """A mark for ``release``."""
    return len(_staged.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the tables staged after the mark ``since``, but for the staged table ``keep``, which replaces them.

    The shuffle files of finished jobs go too: Spark drops them once nothing refers to them and the collector has run.
    Only the caller can know that no other frame still reads the tables.
    """
    kept = {file.rsplit("/", 2)[-2] for file in keep.inputFiles()}
    own = _staged.get(spark.sparkContext.applicationId, [])
    _delete(spark, [p for p in own[since:] if p.rsplit("/", 1)[1] not in kept])


def discard(*tables: DataFrame) -> None:
    """Delete these staged tables, and the shuffle files of finished jobs. Nothing may read the tables afterwards."""
    _delete(tables[0].sparkSession, {file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()})


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    drop_shuffles(spark)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)
