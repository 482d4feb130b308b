"""The registered queries: every operator over the given tables.

Each takes ``(spark, folder)`` and returns a DataFrame. All of them read whole
tables; a row limit appears only where it is the operator itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.timestamps import with_clock
from siftline.operators import context as ctx
from siftline.operators import predicates, render, summary, templates
from siftline.operators.parse import detect_per_key, format_shares, parse, sample_head
from siftline.operators.scan_report import run_scan
from siftline.operators.search import counted, search, search_files
from siftline.session import work_folder
from siftline.sources import rendered as view
from siftline.sources.files import heads, read_lines
from siftline.streaming import follow

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Range used by the time filters; inside the span of the events table.
FROM, TO = "2024-01-08 06:00:00", "2024-01-21T18:30:00"

TEXT_PATTERN = "license"
TEXT_LITERALS = ["Apache License", "mit license", "thanedble"]
TEXT_REGEXES = [r"version \d\.\d", r"[0-9]{3}-[0-9]{4}", r"\bereser\b"]
HIT_PATTERN = r"user=1\d "
MANY_LITERALS = [f"{a}{b}" for a in ("than", "ver", "ción", "eau") for b in ("er", "EA", "ou", "st", "re")]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def _plain(spark: SparkSession, folder: str) -> DataFrame:
    return parse(view.event_lines(spark, folder))


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    return parse(view.numbered_event_lines(spark, folder))


# -- sources ---------------------------------------------------------------------------------


def _files(spark: SparkSession, folder: str, compression: str | None = None) -> list[str]:
    return view.write_event_files(spark, folder, work_folder(spark, "logs"), compression=compression)


@query
def scan_text(spark, folder):
    return read_lines(spark, _files(spark, folder)).select("seq", "raw")


@query
def scan_gz(spark, folder):
    return read_lines(spark, _files(spark, folder, "gzip")).select("seq", "raw")


@query
def scan_bz2(spark, folder):
    return read_lines(spark, _files(spark, folder, "bzip2")).select("seq", "raw")


@query
def multi_file_union(spark, folder):
    logs = _files(spark, folder)
    # argument order decides, and a log named twice is read twice
    return read_lines(spark, [logs[2], logs[0], logs[3], logs[1], logs[0]]).select("seq", "raw")


@query
def glob_scan(spark, folder):
    first = _files(spark, folder)[0]
    lines = read_lines(spark, first.replace("app-0", "app-?"), numbered=False)
    log = F.regexp_extract("file", r"file=([^/]+)/", 1)
    return lines.groupBy(log.alias("log")).agg(F.count(F.lit(1)).alias("n"))


@query
def line_numbers(spark, folder):
    return view.numbered_event_lines(spark, folder).select("event_id", "file", "lineno")


@query
def global_seq(spark, folder):
    return view.numbered_event_lines(spark, folder).select("event_id", "seq")


@query
def lines_from_table(spark, folder):
    return view.document_lines(spark, folder)


@query
def lines_from_pages(spark, folder):
    return view.page_lines(spark, folder)


@query
def lines_from_conversations(spark, folder):
    return view.conversation_lines(spark, folder)


# -- parsing ---------------------------------------------------------------------------------


@query
def sample_head_(spark, folder):
    return sample_head(view.numbered_event_lines(spark, folder)).select("seq", "raw")



@query
def detect_format(spark, folder):
    return detect_per_key(view.numbered_event_lines(spark, folder, "mixed"), ["file"])


@query
def parse_mixed(spark, folder):
    lines = view.numbered_event_lines(spark, folder, "mixed")
    formats = detect_per_key(lines, ["file"]).select("file", "fmt")
    known = lines.join(formats, "file")
    return parse(known, F.col("fmt")).select("event_id", "fmt", "level", "ts", "ts_offset", "message")


@query
def parse_json(spark, folder):
    parsed = parse(view.event_lines(spark, folder, "json"), "json")
    return parsed.select("event_id", "level", "ts", "ts_offset", "message")


@query
def json_extras(spark, folder):
    parsed = parse(view.event_lines(spark, folder, "json"), "json")
    return parsed.select("event_id", F.explode("extras").alias("name", "val"))


@query
def parse_logfmt(spark, folder):
    parsed = parse(view.event_lines(spark, folder, "logfmt"), "logfmt")
    return parsed.select("event_id", "level", "ts", "ts_offset", "message")


@query
def logfmt_extras(spark, folder):
    parsed = parse(view.event_lines(spark, folder, "logfmt"), "logfmt")
    return parsed.select("event_id", F.explode("extras").alias("name", "val"))


@query
def parse_plain(spark, folder):
    return _plain(spark, folder).select("event_id", "level", "ts", "ts_offset", "message")


@query
def parsed_lines(spark, folder):
    return _plain(spark, folder).select(
        "event_id", "raw", "level", "ts", "message", F.size("extras").alias("n_extras"), "cluster_id", "template"
    )


# Text shapes offered to the timestamp rules; the last ones are not accepted.
STAMPS = {
    "iso_z": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    "iso_offset": "yyyy-MM-dd'T'HH:mm:ss'+0530'",
    "iso_west": "yyyy-MM-dd'T'HH:mm:ss.SSS'-07:00'",
    "iso_bare": "yyyy-MM-dd'T'HH:mm:ss",
    "lower_t": "yyyy-MM-dd't'HH:mm:ss.SS",
    "space": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "comma": "yyyy-MM-dd HH:mm:ss,SSS",
    "wide": "'  'yyyy-MM-dd   HH:mm:ss' '",
    "short": "yyyy-M-d H:m:s",
    "access": "dd/MMM/yyyy:HH:mm:ss '+0000'",
    "space_zone": "yyyy-MM-dd HH:mm:ss'Z'",
    "access_bare": "dd/MMM/yyyy:HH:mm:ss",
    "minutes": "yyyy-MM-dd HH:mm",
    "nanos": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'",
    "leap": "yyyy-MM-dd HH:mm:'60'",
    "month_13": "yyyy-'13'-dd HH:mm:ss",
    "feb_30": "yyyy-'02-30' HH:mm:ss",
    "hour_25": "yyyy-MM-dd '25':mm:ss",
    "far_zone": "yyyy-MM-dd'T'HH:mm:ss'+24:00'",
}


@query
def normalize_ts(spark, folder):
    events = view.table(spark, folder, "events")
    shapes = F.array(
        *[F.struct(F.lit(n).alias("shape"), F.date_format("ts", p).alias("text")) for n, p in STAMPS.items()]
    )
    rows = events.select("event_id", F.explode(shapes).alias("s")).select("event_id", "s.shape", "s.text")
    return with_clock(rows, "text").drop("text")


# -- filters ---------------------------------------------------------------------------------


@query
def filter_level(spark, folder):
    return search(view.event_lines(spark, folder), levels=["error", "WARN"]).select("event_id", "level")


@query
def filter_literal(spark, folder):
    return view.document_lines(spark, folder).where(predicates.matches(TEXT_PATTERN))


@query
def filter_regex(spark, folder):
    return view.document_lines(spark, folder).where(predicates.matches(TEXT_REGEXES[0]))


@query
def filter_any_literal(spark, folder):
    return view.document_lines(spark, folder).where(predicates.matches(TEXT_LITERALS))


@query
def filter_any_regex(spark, folder):
    return view.document_lines(spark, folder).where(predicates.matches(TEXT_REGEXES))


@query
def filter_none(spark, folder):
    return view.document_lines(spark, folder).where(predicates.build()).select("doc_id", "lineno")


@query
def filter_mixed_patterns(spark, folder):
    return view.page_lines(spark, folder).where(predicates.matches(["lang=\"de\"", r"track\(\d*7\)"]))


@query
def filter_time_range(spark, folder):
    return search(view.event_lines(spark, folder), from_=FROM, to=TO).select("event_id", "ts")


@query
def filter_time_from(spark, folder):
    return search(view.event_lines(spark, folder), from_=FROM).select("event_id", "ts")


@query
def filter_time_to(spark, folder):
    return search(view.event_lines(spark, folder), to=TO).select("event_id", "ts")


@query
def filter_combined(spark, folder):
    found = search(view.event_lines(spark, folder), ["ERROR", "INFO"], HIT_PATTERN, FROM, TO)
    return found.select("event_id", "level", "ts")


@query
def filter_invert(spark, folder):
    found = search(view.event_lines(spark, folder), ["ERROR", "INFO"], HIT_PATTERN, FROM, TO, invert=True)
    return found.select("event_id", "level", "ts")


@query
def custom_predicate(spark, folder):
    many = predicates.python_predicate(lambda line: line.count("e") >= 20)
    return view.document_lines(spark, folder).where(many(F.col("raw"))).select("doc_id", "lineno")


@query
def search_(spark, folder):
    lines = view.numbered_event_lines(spark, folder)
    found = search(lines, ["ERROR"], "failed", FROM, TO)
    return render.output_record(found, show_file=True, show_lineno=True)



@query
def search_json(spark, folder):
    lines = view.event_lines(spark, folder, "json")
    return search(lines, ["warning", "error"], "value", to=TO, fmt="json").select("event_id", "level", "ts", "message")


@query
def search_logfmt(spark, folder):
    lines = view.event_lines(spark, folder, "logfmt")
    return search(lines, ["warning", "error"], "value", FROM, fmt="logfmt").select("event_id", "level", "ts", "message")


# -- output ----------------------------------------------------------------------------------


@query
def render_text(spark, folder):
    found = search(view.numbered_event_lines(spark, folder), ["ERROR"])
    path = work_folder(spark, "text")
    render.write_matches(found, path, "text", show_file=True, show_lineno=True, order="seq")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def render_json(spark, folder):
    found = search(view.numbered_event_lines(spark, folder), ["ERROR"])
    path = work_folder(spark, "json")
    render.write_matches(found, path, "json", show_lineno=True)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def render_csv(spark, folder):
    found = search(view.numbered_event_lines(spark, folder), ["WARN"])
    path = work_folder(spark, "csv")
    render.write_matches(found, path, "CSV", show_file=True, show_lineno=True)
    layout = "ts STRING, level STRING, msg STRING, file STRING, lineno BIGINT"
    return spark.read.schema(layout).options(header=True, escape='"').csv(path)


@query
def level_tag(spark, folder):
    parsed = parse(view.event_lines(spark, folder, "json"), "json")
    return parsed.select("event_id", render.level_tag(F.col("level")).alias("tag"))


@query
def highlight(spark, folder):
    lines = view.document_lines(spark, folder)
    return lines.select("doc_id", "lineno", render.highlight(F.col("raw"), ["the", r"\d+\.\d+"]).alias("text"))


@query
def output_record(spark, folder):
    return render.output_record(_numbered(spark, folder), show_file=True, show_lineno=True)


# -- context ---------------------------------------------------------------------------------


def _hits():
    return predicates.build(levels=["ERROR"], patterns=HIT_PATTERN, plain=True)


@query
def context_global(spark, folder):
    return ctx.context(_numbered(spark, folder), _hits(), 2).select("seq", "event_id", "hit", "group_id", "new_group")


@query
def context_dense(spark, folder):
    """Many hits: the chunked plan, with small chunks so that borders are met."""
    near = ctx.context(
        _numbered(spark, folder), predicates.level_in(["ERROR"]), 1, chunk_rows=1000, max_broadcast_bytes=0
    )
    return near.select("seq", "event_id", "hit", "group_id", "new_group")


@query
def context_per_file(spark, folder):
    lines = view.document_lines(spark, folder)
    near = ctx.context(lines, predicates.matches(TEXT_LITERALS), 1, order="lineno", keys=["doc_id"])
    return near.select("doc_id", "lineno", "raw", "hit", "group_id", "new_group")


@query
def context_groups(spark, folder):
    near = ctx.context(_numbered(spark, folder), _hits(), 3)
    return near.groupBy("group_id").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count_if("hit").alias("hits")
    )


@query
def context_invert(spark, folder):
    common = predicates.matches([r"button|request", "order|account"])
    near = ctx.context(_numbered(spark, folder), common, 1, invert=True)
    return near.select("seq", "hit", "group_id", "new_group")


@query
def context_zero(spark, folder):
    return ctx.context(_numbered(spark, folder), _hits(), 0).select("seq", "hit", "group_id", "new_group")


@query
def context_text(spark, folder):
    near = ctx.context(_numbered(spark, folder), _hits(), 1)
    path = work_folder(spark, "context")
    render.write_matches(near, path, "text", order="seq")
    return spark.read.text(path).select(F.col("value").alias("line"))


# -- summary ---------------------------------------------------------------------------------


@query
def summary_total(spark, folder):
    return summary.total_rows(view.event_lines(spark, folder))


@query
def summary_by_level(spark, folder):
    return summary.count_by_level(_plain(spark, folder))


@query
def summary_unparsed(spark, folder):
    return summary.unparsed_rows(parse(view.event_lines(spark, folder, "json"), "json"))


@query
def summary_time_span(spark, folder):
    return summary.time_span(_plain(spark, folder))


@query
def summary_(spark, folder):
    row = summary.summary(_plain(spark, folder))
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    return row.withColumn("by_level", F.array_join(F.transform(F.map_entries("by_level"), entry), ", "))



@query
def summary_report(spark, folder):
    return summary.summary_report(parse(view.event_lines(spark, folder, "json"), "json"))


@query
def summary_report_templates(spark, folder):
    parsed = _with_text(_plain(spark, folder))
    counts = templates.template_counts(templates.mine(parsed, "text", order="event_id"))
    return summary.summary_report(parsed, counts)


@query
def search_detected(spark, folder):
    """Files in three formats, each detected by itself."""
    found = search(view.numbered_event_lines(spark, folder, "mixed"), ["ERROR", "WARNING", "WARN"], per_file=True)
    return found.select("event_id", "level", "message")


@query
def search_files_detected(spark, folder):
    """The same of real files: the format comes from the first lines of every file."""
    logs = view.write_event_files(spark, folder, work_folder(spark, "logs"), "mixed", "gzip")
    found = search_files(spark, logs, numbered=False, per_file=True, levels=["ERROR", "WARNING", "WARN"])
    log = F.regexp_extract("file", r"file=([^/]+)/", 1)
    return found.groupBy(log.alias("log"), "level", "message").agg(F.count(F.lit(1)).alias("n"))


@query
def file_formats(spark, folder):
    """Detected format of each log, and how many lines that took."""
    logs = view.write_event_files(spark, folder, work_folder(spark, "logs"), "mixed")
    first = heads(spark, logs).withColumn("log", F.regexp_extract("file", r"file=([^/]+)/", 1))
    formats = format_shares(first, ["log"]).select("log", "fmt")
    read = first.groupBy("log", "file").agg(F.max("lineno").alias("n")).groupBy("log").agg((F.max("n") <= 20).alias("bounded"))
    return formats.join(read, "log")


@query
def search_braces(spark, folder):
    found = search(view.event_lines(spark, folder, "json"), patterns=['"value":5{1,}', 'nothing{"like":'], fmt="json")
    return found.select("event_id")


@query
def search_many_literals(spark, folder):
    return view.document_lines(spark, folder).where(predicates.matches(MANY_LITERALS))


@query
def severity_rollup(spark, folder):
    return summary.severity_rollup(parse(view.event_lines(spark, folder, "logfmt"), "logfmt"))


@query
def scan_metrics(spark, folder):
    parsed = parse(view.event_lines(spark, folder))
    found, seen = counted(parsed, _hits())
    found.write.format("noop").mode("overwrite").save()
    counters = seen.get
    return spark.createDataFrame(
        [(counters["scanned"], counters["matched"])], "scanned BIGINT, matched BIGINT"
    )


@query
def scan_report(spark, folder):
    """Counts of a timed scan, and whether its times and rate fit together."""
    parsed = parse(view.event_lines(spark, folder))
    report = run_scan(parsed, _hits(), lambda found: found.write.format("noop").mode("overwrite").save())
    sound = (F.col("elapsed") > 0) & (F.col("rows_per_second") == F.floor(F.col("scanned") / F.col("elapsed")))
    read = sum(s.input_rows for s in report.stages)
    # rows of the table are read once
    return report.frame(spark).select("scanned", "matched", sound.alias("timed"), F.lit(read).cast("bigint").alias("rows_read"))


def _ordered_document_lines(spark, folder):
    # position over all documents: document, then line
    place = F.shiftleft(F.col("doc_id"), 32) + F.col("lineno")
    return view.document_lines(spark, folder).withColumn("seq", place)


@query
def top_messages(spark, folder):
    counts = summary.count_texts(_ordered_document_lines(spark, folder), "raw")
    return summary.top(counts).select("raw", "n", "first_seq")


@query
def template_label(spark, folder):
    lines = view.document_lines(spark, folder)
    return lines.select("doc_id", "lineno", summary.label(F.col("raw")).alias("label"))


# -- templates -------------------------------------------------------------------------------


def _with_text(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("text", templates.template_text(F.col("message"), F.col("raw")))


@query
def template_text(spark, folder):
    return _with_text(_plain(spark, folder)).select("event_id", "text")


@query
def template_passthrough(spark, folder):
    parsed = parse(view.event_lines(spark, folder, "logfmt"), "logfmt")
    return templates.passthrough(parsed).select("event_id", "cluster_id", "template")


@query
def template_mine(spark, folder):
    assigned = templates.assign(_with_text(_plain(spark, folder)), "text", order="event_id")
    return assigned.select("event_id", "cluster_id", "template")


@query
def template_rounds(spark, folder):
    """Lines of few words that share many of them: the merges take several rounds."""
    lines = templates.mine(view.part_lines(spark, folder), "raw", order="p_partkey")
    return templates.template_counts(lines)


@query
def summary_templates(spark, folder):
    mined = templates.mine(_with_text(_plain(spark, folder)), "text", order="event_id")
    return templates.template_counts(mined)


@query
def top_templates(spark, folder):
    mined = templates.mine(_with_text(_plain(spark, folder)), "text", order="event_id")
    best = summary.top(templates.template_counts(mined))
    return best.select(summary.label(F.col("template")).alias("label"), "n")


@query
def template_mine_text(spark, folder):
    """What holds for every line of text and its template: as many tokens, equal wherever there is no wildcard."""
    lines = templates.assign(_ordered_document_lines(spark, folder), "raw")
    own = templates.masked(F.col("raw"))
    pairs = F.arrays_zip(F.split(own, " ").alias("a"), F.split("template", " ").alias("b"))
    # equal texts have equal tokens; only others are compared token by token
    sound = (own == F.col("template")) | F.forall(pairs, lambda p: (p["b"] == templates.WILDCARD) | (p["a"] == p["b"]))
    return lines.select("doc_id", "lineno", F.size(F.split("template", " ")).alias("n_tokens"), sound.alias("sound"))


# -- streaming -------------------------------------------------------------------------------


def _landed(spark: SparkSession, folder: str) -> str:
    path = work_folder(spark, "landed")
    view.event_lines(spark, folder).select("raw").write.text(path)
    return path


@query
def follow_scan(spark, folder):
    lines = follow.follow_lines(spark, _landed(spark, folder)).select("raw")
    path = work_folder(spark, "followed")
    follow.start_sink(lines, path, work_folder(spark, "state"), "parquet").awaitTermination()
    return spark.read.schema("raw STRING").parquet(path)


@query
def follow_filter(spark, folder):
    found = follow.follow_search(follow.follow_lines(spark, _landed(spark, folder)), ["ERROR"], "failed", FROM)
    path = work_folder(spark, "followed")
    follow.start_sink(found, path, work_folder(spark, "state"), "text").awaitTermination()
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def stream_summary(spark, folder):
    parsed = parse(follow.follow_lines(spark, _landed(spark, folder), max_files_per_batch=3))
    path = work_folder(spark, "live")
    follow.start_live_summary(parsed, path, work_folder(spark, "state")).awaitTermination()
    return follow.live_summary(spark, path)


def _halves(spark: SparkSession, folder: str, path: str):
    """Writes the lines of even events to ``path`` at once; the function that is returned adds the others."""
    lines = view.event_lines(spark, folder)
    lines.where("event_id % 2 = 0").select("raw").write.text(path)
    return lambda: lines.where("event_id % 2 = 1").select("raw").write.mode("append").text(path)


@query
def follow_from_now(spark, folder):
    """Only what lands after the start, one file of it with a time long past."""
    path, place = work_folder(spark, "landed"), work_folder(spark, "known")
    land_rest = _halves(spark, folder, path)
    known = follow.known_files(spark, path, place)
    land_rest()
    late = {r.file for r in spark.read.text(path).select(F.col("_metadata.file_path").alias("file")).distinct().collect()}
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(min(late - {r.file for r in known.collect()}))
    file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).setTimes(file, 1_000_000_000_000, -1)
    lines = follow.follow_lines(spark, path, known=follow.known_files(spark, path, place)).select("raw")
    out = work_folder(spark, "followed")
    follow.start_sink(lines, out, work_folder(spark, "state"), "parquet").awaitTermination()
    return spark.read.schema("raw STRING").parquet(out)


@query
def stream_metrics(spark, folder):
    """Counters of a query that stops in the middle and starts again from its checkpoint."""
    path, out, ledger, state = (work_folder(spark, x) for x in ("landed", "followed", "ledger", "state"))
    land_rest = _halves(spark, folder, path)
    for again in (False, True):
        if again:
            land_rest()
        parsed = parse(follow.follow_lines(spark, path, max_files_per_batch=1))
        follow.start_counted_search(parsed, _hits(), out, ledger, state).awaitTermination()
    return follow.scan_ledger(spark, ledger).select("scanned", "matched")
