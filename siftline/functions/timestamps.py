"""Timestamp text to wall clock and UTC offset.

Accepted shapes, tried on trimmed text with commas read as dots:

* ``Y-m-dTH:M:S[.f][offset]``
* ``Y-m-d H:M:S[.f]`` (no offset)
* ``d/Mon/Y:H:M:S offset``

Anything else gives NULL. The range filter compares wall clocks, so the offset
is kept beside the clock instead of being applied to it.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English month abbreviations, in calendar order.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
_DATE = r"(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
_CLOCK = r"[0-9]{1,2}:[0-9]{1,2}:[0-5]?[0-9]"
_FRACTION = r"(?:[.][0-9]{1,6})?"
_HOUR_OFFSET = r"[+-](?:[01][0-9]|2[0-3])"
_OFFSET = (
    rf"(?:Z|{_HOUR_OFFSET}(?::[0-5][0-9](?::[0-5][0-9](?:[.][0-9]{{1,6}})?)?"
    rf"|[0-5][0-9](?:[0-5][0-9](?:[.][0-9]{{1,6}})?)?))"
)
_END = r"\z"
_ISO = (
    rf"^({_DATE}(?:[Tt]{_CLOCK}{_FRACTION}(?={_OFFSET}?{_END})"
    rf"|\s+{_CLOCK}{_FRACTION}(?={_END})))"
)
_ACCESS = (
    rf"^([0-9]{{1,2}})/((?i:{'|'.join(MONTHS)}))/((?!0000)[0-9]{{4}})"
    rf":([0-9]{{1,2}}):([0-9]{{1,2}}):([0-5]?[0-9])\s+({_OFFSET}){_END}"
)


def _loose(clock: str) -> str:
    return f"try_cast(regexp_replace({clock}, r'[Tt]|\\s+', 'T') AS TIMESTAMP_NTZ)"


def _access(text: str) -> str:
    day, name, year, hour, minute, second = (f"regexp_extract({text}, r'{_ACCESS}', {g})" for g in range(1, 7))
    months = ", ".join(f"'{m.lower()}'" for m in MONTHS)
    date = f"{year} || '-' || array_position(array({months}), lower({name})) || '-' || {day}"
    return f"try_cast({date} || 'T' || {hour} || ':' || {minute} || ':' || {second} AS TIMESTAMP_NTZ)"


_ZONE_SECONDS = """
    (CASE WHEN startswith(_zone, '-') THEN -1 ELSE 1 END) * (
      3600 * int(substr(_zone, 2, 2)) + 60 * int(substr(_zone, 4, 2))
      + CASE WHEN length(_zone) > 5 THEN int(substr(_zone, 6, 2)) ELSE 0 END)"""


def with_clock(df: DataFrame, text: str, ts: str = "ts", offset: str = "ts_offset", exact: bool = False) -> DataFrame:
    """Add the wall clock and the UTC offset in seconds of a timestamp text.

    Both are NULL for text without an accepted shape; the offset is NULL as well
    when the text has none. ``exact`` is for texts known to have one of the first
    two shapes with a capital ``T`` or one blank.

    The shape is matched once, in a column of its own that both results read.
    """
    blanks = "".join(f"\\u{ord(c):04x}" for c in _BLANKS)
    tidy = f"translate({text}, ',', '.')" if exact else f"translate(trim(BOTH '{blanks}' FROM {text}), ',', '.')"
    clock = "try_cast(_clock AS TIMESTAMP_NTZ)"
    zone = "CASE WHEN _clock <> '' THEN substr(_text, length(_clock) + 1) ELSE '' END"
    if not exact:
        other = f"CASE WHEN contains(_text, '/') THEN {_access('_text')} ELSE {_loose('_clock')} END"
        clock = f"coalesce({clock}, {other})"
        zone = f"CASE WHEN contains(_text, '/') THEN regexp_extract(_text, r'{_ACCESS}', 7) ELSE {zone} END"
    seconds = f"CASE WHEN _zone = '' THEN NULL WHEN _zone = 'Z' THEN 0 ELSE {_ZONE_SECONDS} END"
    return (
        df.withColumn("_text", F.expr(tidy))
        .withColumn("_clock", F.expr(f"regexp_extract(_text, r'{_ISO}', 1)"))
        .withColumns({ts: F.expr(clock), "_zone": F.expr(f"translate({zone}, ':', '')")})
        .withColumn(offset, F.expr(f"CASE WHEN {ts} IS NOT NULL THEN {seconds} END"))
        .drop("_text", "_clock", "_zone")
    )


def instant(ts: Column, offset: Column) -> Column:
    """UTC reading of a wall clock; a clock without offset counts as UTC."""
    return ts - F.make_dt_interval(secs=F.coalesce(offset, F.lit(0)))


def timestamp_text(ts: Column, offset: Column | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.ffffff][+hh:mm]``; the fraction shows only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    fine = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    text = F.when(F.date_trunc("second", ts).cast("timestamp_ntz") == ts, whole).otherwise(fine)
    if offset is None:
        return text
    size = F.abs(offset)
    shown = F.format_string("%02d:%02d", (size / 3600).cast("int"), (size % 3600 / 60).cast("int"))
    shown = F.when(size % 60 == 0, shown).otherwise(
        F.concat(shown, F.format_string(":%02d", (size % 60).cast("int")))
    )
    zone = F.concat(F.when(offset < 0, F.lit("-")).otherwise(F.lit("+")), shown)
    return F.concat(text, F.when(offset.isNull(), F.lit("")).otherwise(zone))


def parse_bound(text: str | datetime | None) -> datetime | None:
    """A range bound on the driver, by the same rules; offsets are dropped, not applied."""
    if text is None or text == "":
        return None
    if isinstance(text, datetime):
        return text.replace(tzinfo=None)
    t = text.strip().replace(",", ".")
    iso = re.search(_ISO.replace(_END, r"\Z"), t)
    access = re.search(_ACCESS.replace(_END, r"\Z"), t)
    try:
        if iso:
            day, clock = re.split(r"[Tt]|\s+", iso.group(1), maxsplit=1)
            year, month, dom = (int(x) for x in day.split("-"))
        elif access:
            dom, name, year = int(access.group(1)), access.group(2).title(), int(access.group(3))
            month, clock = MONTHS.index(name) + 1, ":".join(access.group(4, 5, 6))
        else:
            raise ValueError("no accepted shape")
        hour, minute, second = clock.split(":")
        whole, _, fraction = second.partition(".")
        return datetime(
            year, month, dom, int(hour), int(minute), int(whole), int(fraction.ljust(6, "0") if fraction else 0)
        )
    except ValueError as error:
        raise ValueError(f"cannot read {text!r} as a timestamp: {error}") from None
