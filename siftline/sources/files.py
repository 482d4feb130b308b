"""Text files as positioned lines: file, line number, position in the whole input."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftline.functions.staging import once
from siftline.session import pin_split_layout, prepare, stage, work_folder

SAMPLE_ROWS = 20

# The per-split table is broadcast up to this many splits (about 32 MB of rows);
# beyond it the lines are joined to it by shuffle.
MAX_BROADCAST_SPLITS = 200_000

# Files of a codec that cannot be split are spread over the cluster after
# numbering when they are larger than this.
SPREAD_BYTES = 256 << 20

# Files whose beginnings one job reads.
FILES_AT_ONCE = 64


@dataclass(frozen=True)
class InputFile:
    ordinal: int
    name: str
    uri: str
    location: str
    size: int


def _bytes(setting: str) -> int:
    """A Spark size setting such as ``134217728b`` or ``64m`` in bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", setting.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def expand(spark: SparkSession, paths: str | list[str]) -> list[InputFile]:
    """Resolve each argument in order: a glob gives its matches sorted, a folder its files sorted.

    An argument without any match raises ``FileNotFoundError``. Naming a file
    twice reads it twice. Spark's readers pass over files whose name begins with ``_`` or ``.``: in a folder
    they are left out here too, but named by an argument they raise ``ValueError``.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    new_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found: list[InputFile] = []
    for argument in [paths] if isinstance(paths, str) else paths:
        pattern = new_path(argument)
        fs = pattern.getFileSystem(conf)
        matches = list(fs.globStatus(pattern) or [])
        if not pattern.getName().startswith("."):
            literal = [m for m in matches if m.getPath().getName() == pattern.getName()]
            matches = literal or [m for m in matches if not m.getPath().getName().startswith(".")]
        if not matches and fs.exists(pattern):
            matches = [fs.getFileStatus(pattern)]
        if not matches:
            raise FileNotFoundError(f"path does not exist: {argument!r}")
        for match in sorted(matches, key=lambda m: m.getPath().toString()):
            inner = fs.listStatus(match.getPath()) if match.isDirectory() else [match]
            for status in sorted(inner, key=lambda m: m.getPath().toString()):
                base = status.getPath().getName()
                hidden = base.startswith(("_", "."))
                if hidden and match.isFile():
                    raise ValueError(f"Spark does not read files named like {base!r}; rename the file to read it")
                if status.isFile() and not hidden:
                    path = status.getPath()
                    name = argument if match.isFile() and len(matches) == 1 else path.toUri().getPath()
                    # names with glob characters must not be expanded again by the reader
                    location = re.sub(r"([\[\]{}*?\\])", r"\\\1", path.toString())
                    found.append(InputFile(len(found), name, path.toUri().toString(), location, status.getLen()))
    return found


def _same_scheme(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file:/+", "file:/")


def _scan(spark: SparkSession, locations: list[str]) -> DataFrame:
    """Lines with the URI of their file; invalid UTF-8 becomes U+FFFD."""
    return spark.read.text(locations).select(
        F.make_valid_utf8("value").alias("raw"), F.col("_metadata.file_path").alias("_uri"), "_metadata"
    )


def _scan_splits(spark: SparkSession, files: list[InputFile]) -> DataFrame:
    """Each file once, with split and row identity."""
    return _scan(spark, list(dict.fromkeys(f.location for f in files))).select(
        "raw",
        _same_scheme(F.col("_uri")).alias("_uri"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )


def _path(uri: Column) -> Column:
    """The path of a file URI, without scheme and host, decoded."""
    path = F.regexp_replace(uri, "^[A-Za-z0-9+.-]+:(?://[^/]*)?", "")
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _uri_path(uri: str) -> str:
    return unquote(urlsplit(uri).path)


def _split_bound(spark: SparkSession, files: list[InputFile]) -> int:
    """An upper bound on the number of scan splits, from the listing alone."""
    size = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return len(files) + pin_split_layout(spark) + sum(f.size for f in files) // size + 1


def split_positions(lines: DataFrame, files: list[InputFile]) -> DataFrame:
    """Per split and input file: first row id, rows, lines before it in the file and in the input.

    One narrow pass over the files counts rows per split. The running totals
    work on one row per split (128 MB of text by default, so 100 TB give about
    800,000 rows), in input order.
    """
    spark = lines.sparkSession
    order = spark.createDataFrame(
        [(f.ordinal, f.name, f.uri) for f in files], "ordinal INT, file STRING, _uri STRING"
    ).withColumn("_uri", _same_scheme(F.col("_uri")))
    splits = lines.groupBy("_uri", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("ordinal", "_block")) - F.col("_rows")
    in_file = F.sum("_rows").over(W.partitionBy("ordinal").orderBy("_block")) - F.col("_rows")
    return (
        splits.join(order, "_uri")
        .withColumn("_before", before)
        .withColumn("_offset", in_file)
        .select("_uri", "_block", "_first", "_rows", "file", "_offset", (F.col("_before") - F.col("_offset")).alias("_file_offset"))
    )


def read_lines(spark: SparkSession, paths: str | list[str], numbered: bool = True) -> DataFrame:
    """Lines of plain, ``.gz`` or ``.bz2`` text files: ``file, lineno, seq, raw``.

    ``file`` is the path; a single file keeps the name it was given by.

    ``lineno`` counts from 1 in each file, ``seq`` over the whole input in
    argument order. Numbering counts the rows of every split in one narrow pass,
    run here; its table (one row per split) is kept in the shared folder, so that
    later jobs over the lines read the files once each. Without ``numbered`` only
    ``file, raw`` are produced, without that pass or any join.
    """
    prepare(spark)
    files = expand(spark, paths)
    if not files:
        empty = "file STRING, lineno BIGINT, seq BIGINT, raw STRING" if numbered else "file STRING, raw STRING"
        return spark.createDataFrame([], empty)
    if not numbered:
        # Reading a path twice gives its lines twice.
        result = _scan(spark, [f.location for f in files]).select(_path(F.col("_uri")).alias("file"), "raw")
    else:
        lines = _scan_splits(spark, files)
        places = stage(split_positions(lines, files), "splits")
        if _split_bound(spark, files) <= MAX_BROADCAST_SPLITS:
            places = F.broadcast(places)
        # Left join plus the check below: a line outside its counted split stops
        # the job instead of getting a wrong number. The check is computed in a
        # step of its own, which later filters cannot turn into an inner join.
        joined = lines.join(places, ["_uri", "_block"], "left")
        row = F.col("_id") - F.col("_first")
        lineno = F.col("_offset") + row + 1
        place = F.struct(
            F.col("file"), lineno.alias("lineno"), (F.col("_file_offset") + lineno).alias("seq")
        )
        sound = F.col("_rows").isNotNull() & (row >= 0) & (row < F.col("_rows"))
        wrong = F.raise_error(F.lit("input files changed or were split differently between two passes"))
        checked = F.when(sound, place).otherwise(wrong)
        result = once(joined, "_place", checked).select("_place.file", "_place.lineno", "_place.seq", "raw")
    large = [f.uri for f in files if f.uri.endswith(".gz") and f.size > SPREAD_BYTES]
    if large:
        names = [f.name for f in files if f.uri in large] if numbered else [_uri_path(u) for u in large]
        alone = F.col("file").isin(names)
        result = result.where(~alone).unionByName(result.where(alone).hint("rebalance"))
    return result


def head(spark: SparkSession, paths: str | list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first ``rows`` lines of the input; opens only as many files as it needs."""
    prepare(spark)
    taken: list[tuple[int, str]] = []
    for f in expand(spark, paths):
        if len(taken) >= rows:
            break
        if f.size:
            # take() reads the first split first, and stops there when it is enough
            part = _scan(spark, [f.location]).select("raw").take(rows - len(taken))
            taken += [(len(taken) + i + 1, line.raw) for i, line in enumerate(part)]
    return spark.createDataFrame(taken, "seq BIGINT, raw STRING")


def heads(spark: SparkSession, paths: str | list[str], rows: int = SAMPLE_ROWS, numbered: bool = True) -> DataFrame:
    """``file, lineno, raw``: the first ``rows`` lines of every file, each file once.

    One task for each file, which opens its beginning and stops there; nothing is numbered or sorted. The result is
    kept in the shared folder. ``file`` is as in ``read_lines``, with or without ``numbered``. Files without lines give none.

    Only a plan's own limit ends a scan early, so a file is a plan of its own; they run in jobs of ``FILES_AT_ONCE`` files.
    """
    prepare(spark)
    files = list({f.uri: f for f in expand(spark, paths) if f.size}.values())
    schema = "file STRING, lineno BIGINT, raw STRING"
    if not files:
        return spark.createDataFrame([], schema)
    # a session whose scans make one split of a file, whatever its size
    alone = spark.newSession()
    size = str(max(f.size for f in files) + 1)
    alone.conf.set("spark.sql.files.maxPartitionBytes", size)
    alone.conf.set("spark.sql.files.openCostInBytes", size)
    alone.conf.set("spark.sql.unionOutputPartitioning", "false")  # else all files of a job are one task

    def beginning(f: InputFile) -> DataFrame:
        name = F.lit(f.name if numbered else _uri_path(f.uri))
        number = F.monotonically_increasing_id() + 1
        lines = alone.read.text(f.location).select(name.alias("file"), number.alias("lineno"), F.make_valid_utf8("value").alias("raw"))
        return lines.coalesce(1).limit(rows)

    place = work_folder(spark, "heads")
    for at in range(0, len(files), FILES_AT_ONCE):
        first, *others = map(beginning, files[at : at + FILES_AT_ONCE])
        reduce(DataFrame.unionAll, others, first).write.mode("append").parquet(place)
    return spark.read.schema(schema).parquet(place)
