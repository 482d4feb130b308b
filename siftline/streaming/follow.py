"""Follow mode: the same search and summary over lines that keep arriving."""

from __future__ import annotations

import threading
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from siftline.operators.predicates import definite
from siftline.operators.render import CSV_OPTIONS, json_line, output_record, text_lines
from siftline.operators.search import search
from siftline.session import prepare
from siftline.streaming import versions


def follow_lines(
    spark: SparkSession,
    folder: str,
    since: datetime | None = None,
    max_files_per_batch: int | None = None,
    max_file_age: str = "36500d",
    known: DataFrame | None = None,
) -> DataFrame:
    """A stream of ``file, raw`` over text files landing in ``folder``.

    A file counts by its name, not its age: one that lands late is read unless it is ``max_file_age`` older than the
    newest file seen. A shorter age lets Spark forget the names of old files.

    ``known`` (from ``known_files``) skips the files that were there when following began, whatever the times of those that
    land later. ``since`` skips files last written before that moment, those that land later too. Without either
    the files already there are read as well.
    """
    reader = prepare(spark).readStream.format("text").option("maxFileAge", max_file_age)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    lines = reader.load(folder)
    if since is not None:
        moment = since if since.tzinfo else since.replace(tzinfo=timezone.utc)
        lines = lines.where(F.col("_metadata.file_modification_time") >= F.lit(moment))
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"), F.make_valid_utf8("value").alias("raw")
    )
    if known is not None:
        lines = lines.join(known.withColumnRenamed("size", "_size"), ["file", "_size"], "left_anti")
    return lines.drop("_size")


def known_files(spark: SparkSession, folder: str, place: str) -> DataFrame:
    """``file, size`` of the files in ``folder`` when this was first called with ``place``.

    Keep ``place`` next to the checkpoint: a query that starts again must leave out the same files. A file whose
    size has changed since then is not the known one. No content is read.
    """
    listed = prepare(spark).read.format("binaryFile").load(folder)
    listed = listed.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    if versions.current(spark, place) is None:
        versions.publish(listed, place, 0)
    return versions.read(spark, place, "file STRING, size BIGINT")


def follow_search(
    lines: DataFrame,
    levels: Sequence[str] = (),
    patterns: str | Sequence[str] | None = (),
    from_: str | datetime | None = None,
    to: str | datetime | None = None,
    invert: bool = False,
    fmt: str = "plaintext",
) -> DataFrame:
    """Matching parsed lines of a stream. The format is given, not detected."""
    return search(lines, levels, patterns, from_, to, invert, fmt)


def observe_scan(parsed: DataFrame, test: Column, name: str = "scan") -> DataFrame:
    """Keep matching rows; each micro-batch reports rows scanned and matched in its progress."""
    marked = parsed.withColumn("_match", definite(test)).observe(
        name, F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("_match")).alias("matched")
    )
    return marked.where("_match").drop("_match")


class ScanTotals(StreamingQueryListener):
    """Rows scanned and matched over all batches of the queries of a session that ``observe_scan`` reports on.

    Attach it with ``watch_scans`` before a query starts. Totals do not depend on how much progress a
    query keeps; a batch that is reported again counts once.
    """

    def __init__(self, name: str = "scan"):
        self.name = name
        self._news = threading.Condition()
        self._totals: dict[str, list[int]] = {}  # run: scanned, matched, last batch
        self._ended: set[str] = set()

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        seen = event.progress.observedMetrics.get(self.name)
        if seen is None:
            return
        with self._news:
            own = self._totals.setdefault(str(event.progress.runId), [0, 0, -1])
            if event.progress.batchId > own[2]:
                own[:] = own[0] + seen.scanned, own[1] + seen.matched, event.progress.batchId

    def onQueryTerminated(self, event):
        with self._news:
            self._ended.add(str(event.runId))
            self._news.notify_all()

    def totals(self, query: StreamingQuery, seconds: float = 60) -> dict[str, int]:
        """Counts of one run of a query; of a finished one, after all its batches have been reported."""
        run = str(query.runId)
        with self._news:
            if not query.isActive and not self._news.wait_for(lambda: run in self._ended, seconds):
                raise TimeoutError("the end of the query has not been reported")
            scanned, matched, _ = self._totals.get(run, (0, 0, -1))
        return {"scanned": scanned, "matched": matched}


def watch_scans(spark: SparkSession, name: str = "scan") -> ScanTotals:
    """Attach a new ``ScanTotals``; ``spark.streams.removeListener`` detaches it."""
    watcher = ScanTotals(name)
    spark.streams.addListener(watcher)
    return watcher


def start_sink(
    matches: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = "text",
    every: str | None = None,
) -> StreamingQuery:
    """Append matches to ``path`` as text, JSON lines, CSV or parquet files.

    ``every`` is a processing interval such as ``"1 second"``; without it the
    query drains what is there and stops.
    """
    kind = fmt.lower()
    if kind == "text":
        rows = matches.select(text_lines(matches).alias("value"))
    elif kind in ("json", "csv"):
        rows = output_record(matches.withColumn("lineno", F.lit(None).cast("bigint")), show_file=True)
        if kind == "json":
            kind, rows = "text", rows.select(json_line().alias("value"))
    elif kind == "parquet":
        rows = matches
    else:
        raise ValueError(f"unknown output format {fmt!r}; one of text, json, csv, parquet")
    writer = rows.writeStream.format(kind).outputMode("append")
    if kind == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def _started(rows: DataFrame, each, mode: str, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


_LEDGER = "query STRING, batch BIGINT, scanned BIGINT, matched BIGINT"


def start_counted_search(
    parsed: DataFrame, test: Column, path: str, ledger: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Write the matching rows of a stream to the parquet folder ``path`` and count in ``ledger`` what was scanned.

    The ledger has one row for each query (the id that its checkpoint keeps): totals and the last batch counted in. Rows are
    counted while they are written. A batch that runs again, after a crash or a restart, overwrites its own part
    and is not counted twice; totals go on where the last run of the query ended.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = Observation()
        marked = batch.withColumn("_match", definite(test)).observe(
            seen, F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("_match")).alias("matched")
        )
        marked.where("_match").drop("_match").write.mode("overwrite").parquet(f"{path}/part={number}")
        own = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        news = spark.createDataFrame([(own, number, seen.get["scanned"], seen.get["matched"])], _LEDGER)
        before = versions.read(spark, ledger, _LEDGER)
        # the last row counted of a query is not added again
        again = before.where((F.col("query") == own) & (F.col("batch") >= number))
        added = before.union(news.join(again, "query", "left_anti").select(*news.columns))
        totals = added.groupBy("query").agg(*(f(c).alias(c) for c, f in (("batch", F.max), ("scanned", F.sum), ("matched", F.sum))))
        versions.publish(totals, ledger, number)

    return _started(parsed, keep, "append", checkpoint, every)


def scan_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """``query, batch, scanned, matched``: totals of each query so far, over all its runs."""
    return versions.read(spark, ledger, _LEDGER)


_LIVE = "level STRING, n BIGINT, batch BIGINT"


def start_live_summary(parsed: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Counts by level in the folder ``path``, a new version with each micro-batch.

    A batch brings the levels that changed with their counts so far, laid over the version before it: one row for each level, and
    a bounded number of files however many batches there were. A batch that runs again gives the same version,
    and nothing is held by the driver.
    """
    counts = parsed.groupBy("level").agg(F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        news = batch.select("level", "n", F.lit(number).cast("bigint").alias("batch"))
        both = versions.read(batch.sparkSession, path, _LIVE).union(news)
        latest = both.groupBy("level").agg(F.max_by("n", "batch").alias("n"), F.max("batch").alias("batch"))
        versions.publish(latest, path, number)

    return _started(counts, keep, "update", checkpoint, every)


def live_summary(spark: SparkSession, path: str) -> DataFrame:
    """``level, n`` of a live summary so far, of one version; rows without level count as NULL."""
    return versions.read(spark, path, _LIVE).select("level", "n")
