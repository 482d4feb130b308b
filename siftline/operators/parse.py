"""Format detection and parsing of lines into records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import jsonlines, logfmt, plaintext
from siftline.functions.staging import once
from siftline.functions.timestamps import with_clock
from siftline.schema import FORMATS, RECORD
from siftline.session import prepare
from siftline.sources.files import SAMPLE_ROWS


def sample_head(df: DataFrame, order: str = "seq", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows of positioned lines."""
    return df.orderBy(order).limit(rows)


def format_shares(sample: DataFrame, keys: Sequence[str] = (), raw: str = "raw") -> DataFrame:
    """``keys, fmt``: detected format of sample lines, for the whole input or per key.

    Blank lines do not count. At least half the lines must be JSON objects, else
    at least half must hold two or more ``key=value`` pairs, else plain text.
    """
    prepare(sample.sparkSession)
    text = F.regexp_replace(F.col(raw), r"(?U)^\s+|\s+$", "")
    judged = jsonlines.with_document(once(sample.select(*keys, raw), "_text", text), "_text", "_doc")
    is_json = F.col("_doc").isNotNull()
    judged = judged.withColumns({"_json": is_json, "_logfmt": ~is_json & logfmt.looks_like("_text")})
    counted = F.col("_text") != ""
    shares = judged.groupBy(*keys).agg(
        F.avg(F.when(counted, F.col("_json").cast("int"))).alias("json_share"),
        F.avg(F.when(counted, F.col("_logfmt").cast("int"))).alias("logfmt_share"),
    )
    fmt = (
        F.when(F.col("json_share") >= 0.5, F.lit("json"))
        .when(F.col("logfmt_share") >= 0.5, F.lit("logfmt"))
        .otherwise(F.lit("plaintext"))
    )
    return shares.select(*keys, fmt.alias("fmt"), "json_share", "logfmt_share")


def detect_format(lines: DataFrame, order: str = "seq", raw: str = "raw") -> str:
    """Format name from the first lines (one small job); from any lines if they are not positioned."""
    if order in lines.columns:
        sample = sample_head(lines.select(order, raw), order)
    else:
        sample = lines.select(raw).limit(SAMPLE_ROWS)
    return format_shares(sample, raw=raw).first().fmt


def detect_per_key(lines: DataFrame, keys: Sequence[str], order: str = "lineno", raw: str = "raw") -> DataFrame:
    """Format per key from its first lines; ``order`` counts from 1 within the key."""
    return format_shares(lines.where(F.col(order) <= SAMPLE_ROWS), keys, raw)


def parse(df: DataFrame, fmt: str | Column = "plaintext", raw: str = "raw") -> DataFrame:
    """Add the record columns to a frame of lines.

    ``fmt`` is one format name, or a column naming the format of each row.
    Unknown names are read as plain text. Columns nobody selects later cost
    nothing: they are ordinary expressions and get pruned.
    """
    prepare(df.sparkSession)
    if isinstance(fmt, str):
        return _parse_as(df, fmt if fmt in FORMATS else "plaintext", raw)
    work = once(df, "_fmt", F.when(fmt.isin("json", "logfmt"), fmt).otherwise(F.lit("plaintext")))
    is_json, is_logfmt = F.col("_fmt") == "json", F.col("_fmt") == "logfmt"
    work = jsonlines.with_document(work, raw, "_doc", where="_fmt = 'json'")
    work = once(work, "_pairs", F.when(is_logfmt, logfmt.pairs(raw)))

    def choose(of_json: Column, of_logfmt: Column, of_plain: Column) -> Column:
        return F.when(is_json, of_json).when(is_logfmt, of_logfmt).otherwise(of_plain)

    line = F.col(raw)
    work = work.withColumns(
        {
            "_stamp": choose(jsonlines.stamp("_doc", raw), logfmt.stamp("_pairs"), plaintext.stamp(line)),
            "_others": logfmt.other_pairs("_pairs"),
        }
    )
    return _record(
        with_clock(work, "_stamp"),
        df.columns,
        level=choose(jsonlines.level("_doc", raw), logfmt.level("_pairs"), plaintext.level(line)),
        message=choose(jsonlines.message("_doc", raw), logfmt.message("_pairs"), plaintext.message(line)),
        extras=choose(jsonlines.extras("_doc", raw), logfmt.extras("_others"), F.lit(None)),
    )


def _parse_as(df: DataFrame, fmt: str, raw: str) -> DataFrame:
    if fmt == "json":
        work = jsonlines.with_document(df, raw, "_doc")
        work = work.withColumn("_stamp", jsonlines.stamp("_doc", raw))
        fields = {
            "level": jsonlines.level("_doc", raw),
            "message": jsonlines.message("_doc", raw),
            "extras": jsonlines.extras("_doc", raw),
        }
    elif fmt == "logfmt":
        work = once(df, "_pairs", logfmt.pairs(raw))
        work = work.withColumns({"_stamp": logfmt.stamp("_pairs"), "_others": logfmt.other_pairs("_pairs")})
        fields = {
            "level": logfmt.level("_pairs"),
            "message": logfmt.message("_pairs"),
            "extras": logfmt.extras("_others"),
        }
    else:
        line = F.col(raw)
        work = df.withColumn("_stamp", plaintext.stamp(line))
        fields = {"level": plaintext.level(line), "message": plaintext.message(line), "extras": F.lit(None)}
    work = with_clock(work, "_stamp", exact=fmt == "plaintext")
    return _record(work, df.columns, **fields)


def _record(work: DataFrame, columns: Sequence[str], level: Column, message: Column, extras: Column) -> DataFrame:
    """The input columns followed by the record columns."""
    kinds = {f.name: f.dataType for f in RECORD.fields}
    values = {
        "level": level,
        "ts": F.col("ts"),
        "ts_offset": F.col("ts_offset"),
        "message": message,
        "extras": F.coalesce(extras.cast(kinds["extras"]), F.expr("CAST(map() AS MAP<STRING, STRING>)")),
        "cluster_id": F.lit(-1),
        "template": F.lit(None),
    }
    kept = [c for c in columns if c not in values]
    return work.select(*kept, *[value.cast(kinds[name]).alias(name) for name, value in values.items()])
