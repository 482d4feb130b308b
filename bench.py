"""Time the headline queries over log lines rendered from the given tables.

The event and document tables are first written as text files (not timed).
Every timed query reads those files and runs to a sink that discards its rows. The plain filters name the event files
40 times, which gives 4 million lines at scale 0.1. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftline.operators import summary as S
from siftline.operators import templates as T
from siftline.operators.context import context
from siftline.operators.parse import parse
from siftline.operators.predicates import build, level_in
from siftline.operators.render import output_record
from siftline.operators.search import search
from siftline.session import prepare, work_folder
from siftline.sources.files import read_lines
from siftline.sources.rendered import document_lines, event_lines

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
REPEATS = int(os.environ.get("BENCH_REPEATS", "40"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("siftline-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def write_inputs(spark: SparkSession) -> tuple[dict[str, str], dict[str, int]]:
    """Text files by name, and their line counts."""
    sources = {fmt: event_lines(spark, FOLDER, fmt).orderBy("event_id") for fmt in ("plaintext", "json", "logfmt")}
    sources["documents"] = document_lines(spark, FOLDER).orderBy("doc_id", "lineno")
    paths, counts = {}, {}
    for name, lines in sources.items():
        path = work_folder(spark, f"bench-{name}")
        lines.select("raw").write.text(path)
        paths[name], counts[name] = f"{path}/part-*", lines.count()
    return paths, counts


def main() -> None:
    spark = session()
    paths, counts = write_inputs(spark)

    def lines(name: str, numbered: bool = False):
        return read_lines(spark, paths[name], numbered=numbered)

    def many():
        return read_lines(spark, [paths["plaintext"]] * REPEATS, numbered=False)

    counts["many"] = counts["plaintext"] * REPEATS

    def texts():
        parsed = parse(lines("plaintext", True))
        return parsed.withColumn("text", T.template_text(F.col("message"), F.col("raw")))

    few = build(levels=["ERROR"], patterns=r"user=1\d ", plain=True)
    queries = {
        "level_filter": ("many", lambda: search(many(), ["ERROR"], fmt="plaintext").select("raw")),
        "pattern_filter": ("many", lambda: search(many(), patterns="failed", fmt="plaintext").select("raw")),
        "pattern_filter_repeat": ("many", lambda: search(many(), patterns="failed", fmt="plaintext").select("raw")),
        "regex_filter": ("many", lambda: search(many(), patterns=r"user=1\d ", fmt="plaintext").select("raw")),
        "any_literal_documents": (
            "documents",
            lambda: search(lines("documents"), patterns=["license", "thanedble", "nicht"], fmt="plaintext").select("raw"),
        ),
        "time_range": (
            "many",
            lambda: search(many(), from_="2024-01-08 06:00:00", to="2024-01-21 18:30:00", fmt="plaintext").select("raw"),
        ),
        "json_level_filter": ("json", lambda: search(lines("json"), ["ERROR"], fmt="json").select("raw")),
        "logfmt_level_filter": ("logfmt", lambda: search(lines("logfmt"), ["ERROR"], fmt="logfmt").select("raw")),
        "parse_records": ("plaintext", lambda: parse(lines("plaintext"))),
        "numbered_output": (
            "plaintext",
            lambda: output_record(search(lines("plaintext", True), ["ERROR"], fmt="plaintext"), show_file=True, show_lineno=True),
        ),
        "summary_report": ("plaintext", lambda: S.summary_report(parse(lines("plaintext")))),
        "context_few_hits": ("plaintext", lambda: context(parse(lines("plaintext", True)), few, 3)),
        "context_many_hits": (
            "plaintext",
            lambda: context(parse(lines("plaintext", True)), level_in(["ERROR"]), 1, max_broadcast_bytes=0),
        ),
        "template_counts": ("plaintext", lambda: S.top(T.template_counts(T.mine(texts(), "text")))),
        "template_counts_documents": (
            "documents",
            lambda: S.top(T.template_counts(T.mine(lines("documents", True), "raw"))),
        ),
    }
    seconds, rates = {}, {}
    for name, (source, make) in queries.items():
        times = []
        for run in range(RUNS):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            if run or RUNS == 1:  # the first run warms up
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.mean(times), 4)
        rates[name] = int(counts[source] / seconds[name])
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline log queries",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "lines": counts,
                "lines_per_sec": rates,
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
