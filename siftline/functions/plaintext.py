"""Plain text lines: level word, message and timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level words (WARNING is reported as WARN), the timestamp shape looked for inside a line, and
# the characters dropped between a level word and the message.
LEVEL_WORDS = r"CRITICAL|FATAL|ERROR|WARN|INFO|DEBUG|TRACE"
LEVEL = rf"\b(?=[CFEWIDT])({LEVEL_WORDS})(?:(?<=WARN)ING)?\b"
TIMESTAMP_SHAPE = r"([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)"
MESSAGE_LEAD = r"[ :|-]*"

# A cheap necessary condition per level: a piece of the word without the letter
# i, whose dotless form also matches the word when case is ignored.
_PIECES = {
    "CRITICAL": "cal",
    "FATAL": "fatal",
    "ERROR": "error",
    "WARN": "warn",
    "INFO": "nfo",
    "DEBUG": "debug",
    "TRACE": "trace",
}


def level(raw: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(raw, f"(?iU){LEVEL}", 1)), F.lit(""))


def message(raw: Column) -> Column:
    rest = F.regexp_extract(raw, rf"(?iUs)^.*?{LEVEL}{MESSAGE_LEAD}(.*)\z", 2)
    return F.coalesce(F.nullif(rest, F.lit("")), raw)


def stamp(raw: Column) -> Column:
    """The first timestamp-like text of the line ('' when there is none)."""
    return F.regexp_extract(raw, TIMESTAMP_SHAPE, 1)


def may_have_level(raw: Column, levels: list[str]) -> Column:
    """False only for lines that cannot carry one of ``levels``; spares them the regex."""
    pieces = sorted({_PIECES[lv.upper()] for lv in levels if lv.upper() in _PIECES})
    test = F.lit(False)
    for piece in pieces:
        test = test | F.contains(F.lower(raw), F.lit(piece))
    return test
