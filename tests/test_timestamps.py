from datetime import datetime

import pytest

from siftline.functions.timestamps import parse_bound, timestamp_text, with_clock
from pyspark.sql import functions as F

# text, wall clock, offset in seconds
CLOCKS = [
    ("2024-01-15T14:00:01Z", "2024-01-15 14:00:01", 0),
    ("2024-01-15T14:00:01+02:00", "2024-01-15 14:00:01", 7200),
    ("2024-01-15T14:00:01-0730", "2024-01-15 14:00:01", -27000),
    ("2024-01-15T14:00:01.5+00:00", "2024-01-15 14:00:01.500000", 0),
    ("2024-01-15T14:00:01", "2024-01-15 14:00:01", None),
    ("2024-01-15t14:00:01", "2024-01-15 14:00:01", None),
    ("2024-01-15 14:00:01", "2024-01-15 14:00:01", None),
    ("2024-01-15 14:00:01.250", "2024-01-15 14:00:01.250000", None),
    ("2024-01-15 14:00:01,250", "2024-01-15 14:00:01.250000", None),
    ("2024-01-15   14:00:01", "2024-01-15 14:00:01", None),
    ("  2024-01-15 14:00:01\t", "2024-01-15 14:00:01", None),
    ("2024-1-5 1:2:3", "2024-01-05 01:02:03", None),
    ("2024-02-29 14:00:00", "2024-02-29 14:00:00", None),
    ("0001-01-01 00:00:00", "0001-01-01 00:00:00", None),
    ("15/Jan/2024:14:00:01 +0000", "2024-01-15 14:00:01", 0),
    ("15/jan/2024:14:00:01 -0730", "2024-01-15 14:00:01", -27000),
    ("5/Feb/2024:1:2:3 Z", "2024-02-05 01:02:03", 0),
    ("2024-01-15T14:00:01+23:59", "2024-01-15 14:00:01", 86340),
    ("2024-01-15T14:00:01+02:00:30", "2024-01-15 14:00:01", 7230),
    ("2024-01-15T14:00:01+020030", "2024-01-15 14:00:01", 7230),
    ("9999-12-31 23:59:59.999999", "9999-12-31 23:59:59.999999", None),
]

NO_CLOCKS = [
    "2024-01-15T14:00:01z", "2024-01-15T14:00:01.123456789Z", "2024-01-15 14:00:01Z", "2024-01-15 14:00:01+02:00",
    "2024-01-15 14:00", "2024-01-15", "2024-13-15 14:00:00", "2024-02-30 14:00:00", "2023-02-29 14:00:00",
    "2024-01-15 25:00:00", "2024-01-15 24:00:00", "2024-01-15 14:61:00", "2024-01-15 14:00:60",
    "2024-01-15 14:00:61", "0000-01-15 14:00:00", "31/Feb/2024:01:02:03 +0000", "15/Jan/2024:14:00:01",
    "15/Foo/2024:14:00:01 +0000", "2024-01-15T14:00:01+24:00", "2024-01-15T14:00:01+02:75",
    "2024-01-15T14:00:01+02:0030", "2024-01-15T14:00:01 +02:00", "2024-01-15T14:00:01.",
    "2024-01-15T14:00:01.+02:00", "1705327200", "", "now", "2024-01-15 14:00:01 extra",
]

WANT = {t: (datetime.fromisoformat(clock), offset) for t, clock, offset in CLOCKS} | dict.fromkeys(NO_CLOCKS, (None, None))


def test_clocks_and_offsets(spark):
    df = spark.createDataFrame(list(enumerate(WANT)), "i INT, text STRING")
    got = {r.text: (r.ts, r.ts_offset) for r in with_clock(df, "text").collect()}
    assert {t: got[t] for t in WANT if got[t] != WANT[t]} == {}


@pytest.mark.parametrize("text", WANT)
def test_bounds(text):
    if text == "":
        assert parse_bound(text) is None
    elif text in NO_CLOCKS:
        with pytest.raises(ValueError):
            parse_bound(text)
    else:
        assert parse_bound(text) == WANT[text][0]


def test_exact_texts_skip_the_loose_forms(spark):
    texts = ["2024-01-15 14:00:01", "2024-01-15 14:00:01Z", ""]
    df = spark.createDataFrame([("2024-01-15T14:00:01,5+0200",), *((t,) for t in texts)], "text STRING")
    rows = [(r.ts, r.ts_offset) for r in with_clock(df, "text", exact=True).collect()]
    assert rows == [(datetime(2024, 1, 15, 14, 0, 1, 500000), 7200), *(WANT[t] for t in texts)]


def test_text_shows_fraction_and_offset_only_when_present(spark):
    rows = [
        (datetime(2024, 1, 15, 14, 0, 1), None), (datetime(2024, 1, 15, 14, 0, 1, 500), 7200),
        (datetime(2024, 1, 15, 14, 0, 1), -27000), (datetime(2024, 1, 15, 14, 0, 1), 0), (None, None),
    ]
    df = spark.createDataFrame(rows, "ts TIMESTAMP_NTZ, off INT")
    got = [r[0] for r in df.select(timestamp_text(F.col("ts"), F.col("off"))).collect()]
    assert got == [
        "2024-01-15 14:00:01", "2024-01-15 14:00:01.000500+02:00", "2024-01-15 14:00:01-07:30",
        "2024-01-15 14:00:01+00:00", None,
    ]
