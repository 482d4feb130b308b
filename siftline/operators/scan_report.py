"""What a scan did: rows scanned and matched, elapsed time, rate, and the time and input of each of its stages."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from siftline.operators.search import counted, scan_rate


@dataclass(frozen=True)
class StageTime:
    """One stage that ran: wall time, and over its tasks the time spent and what they read of the input."""

    stage: int
    tasks: int
    seconds: float
    task_seconds: float
    input_bytes: int
    input_rows: int


@dataclass(frozen=True)
class ScanReport:
    scanned: int
    matched: int
    seconds: float
    stages: tuple[StageTime, ...]

    @property
    def rows_per_second(self) -> int:
        return scan_rate(self.scanned, self.seconds)

    def frame(self, spark: SparkSession) -> DataFrame:
        """``scanned, matched, elapsed, rows_per_second``: one row."""
        return spark.createDataFrame(
            [(self.scanned, self.matched, self.seconds, self.rows_per_second)],
            "scanned BIGINT, matched BIGINT, elapsed DOUBLE, rows_per_second BIGINT",
        )

    def stage_frame(self, spark: SparkSession) -> DataFrame:
        """One row for each stage that ran, in order."""
        rows = [(s.stage, s.tasks, s.seconds, s.task_seconds, s.input_bytes, s.input_rows) for s in self.stages]
        schema = "stage INT, tasks INT, seconds DOUBLE, task_seconds DOUBLE, input_bytes BIGINT, input_rows BIGINT"
        return spark.createDataFrame(rows, schema)


def stage_times(spark: SparkSession, tag: str) -> tuple[StageTime, ...]:
    """The stages of the jobs with a tag, from the figures Spark keeps of its own jobs; skipped stages are left out."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()  # figures arrive a little later than results
    store = context.statusStore()
    jobs = store.jobsList(None)
    numbers: set[int] = set()
    for i in range(jobs.size()):
        if jobs.apply(i).jobTags().contains(tag):
            own = jobs.apply(i).stageIds()
            numbers |= {own.apply(k) for k in range(own.size())}
    found = []
    for number in sorted(numbers):
        last = store.lastStageAttempt(number)
        if last.submissionTime().isDefined() and last.completionTime().isDefined():
            wall = last.completionTime().get().getTime() - last.submissionTime().get().getTime()
            found.append(
                StageTime(
                    number, last.numTasks(), wall / 1000, last.executorRunTime() / 1000, last.inputBytes(), last.inputRecords()
                )
            )
    return tuple(found)


def run_scan(parsed: DataFrame, test: Column, write: Callable[[DataFrame], object]) -> ScanReport:
    """Hand the matching rows to ``write``, which runs one action over them, and report on that run.

    Rows are counted while they are written; nothing is read a second time. Elapsed is the wall time of ``write``. The
    stages are those of its jobs; Spark keeps figures of the latest ones only (``spark.ui.retainedStages``). Other
    actions of the session may run at the same time.
    """
    spark = parsed.sparkSession
    tag = f"siftline-scan-{uuid.uuid4().hex}"
    found, seen = counted(parsed, test, tag)
    spark.sparkContext.addJobTag(tag)
    try:
        start = time.perf_counter()
        write(found)
        seconds = time.perf_counter() - start
    finally:
        spark.sparkContext.removeJobTag(tag)
    counters = seen.get
    return ScanReport(counters["scanned"], counters["matched"], seconds, stage_times(spark, tag))
