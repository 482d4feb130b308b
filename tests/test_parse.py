import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import PLAIN
from siftline.operators.parse import detect_format, detect_per_key, parse
from siftline.schema import RECORD

AT = datetime(2024, 1, 15, 14, 0, 1)


def one(lines, text, fmt):
    return parse(lines([text]), fmt).first()


def all_rows(lines, table, fmt):
    """Parsed rows next to their expectation, in one job."""
    rows = parse(lines([case[0] for case in table]), fmt).orderBy("seq").collect()
    return list(zip(rows, table))


PLAIN_LEVEL_AND_MESSAGE = [
    ("2023-06-02 09:30:04 ERROR  payment gateway unreachable", "ERROR", "payment gateway unreachable"),
    ("Warning: low", "WARN", "low"),
    ("WARNINGS: low", None, "WARNINGS: low"),
    ("[WARN] disk", "WARN", "] disk"),
    ("ERROR", "ERROR", "ERROR"),
    ("error :-| ", "ERROR", "error :-| "),
    ("fatal|critical", "FATAL", "critical"),
    ("no word here", None, "no word here"),
    ("INFOING not a level, debug is", "DEBUG", "is"),
    ("ERRORé éerror", None, "ERRORé éerror"),
    ("\x00\x01 garbage �", None, "\x00\x01 garbage �"),
    ("", None, ""),
    ("x error y z", "ERROR", "y z"),
]


def test_plain_level_and_message(lines):
    for row, case in all_rows(lines, PLAIN_LEVEL_AND_MESSAGE, "plaintext"):
        assert (row.raw, row.level, row.message) == case


PLAIN_TIME = [
    ("2024-01-15 14:00:01Z ERROR x", None, None),
    ("2024-01-15T14:00:01+02:00 ERROR x", AT, 7200),
    ("2024-01-15 14:00:01,250 ERROR x", AT.replace(microsecond=250000), None),
    ("2024-01-15T14:00:01.123456789Z ERROR", None, None),
    ("at 2024-01-15T14:00:01, then 2025-01-01 00:00:00", AT, None),
    ("2024-13-15 14:00:01 then 2024-01-15 14:00:01", None, None),
    ("15/Jan/2024:14:00:01 +0000", None, None),
]


def test_plain_time(lines):
    for row, case in all_rows(lines, PLAIN_TIME, "plaintext"):
        assert (row.raw, row.ts, row.ts_offset) == case


JSON_LEVEL_AND_MESSAGE = [
    ('{"level":"warning"}', "WARNING", ""),
    ('{"level":0,"lvl":"info"}', "INFO", ""),
    ('{"level":"0"}', "0", ""),
    ('{"level":"","severity":[],"lvl":{},"LEVEL":"trace"}', "TRACE", ""),
    ('{"level":false,"severity":null,"lvl":-0.0}', None, ""),
    ('{"severity":"error","message":"disk \\"full\\" \\u00e9"}', "ERROR", 'disk "full" é'),
    ('{"level":"a","level":"b"}', "B", ""),
    ('{"MESSAGE":0}', None, "0"),
    ('{"msg":"","MESSAGE":""}', None, ""),
    ('{"msg":12}', None, "12"),
    ('  {"msg":"x"} ', None, "x"),
]


def test_json_level_and_message(lines):
    for row, case in all_rows(lines, JSON_LEVEL_AND_MESSAGE, "json"):
        assert (row.raw, row.level, row.message) == case


NOT_ONE_OBJECT = [
    '{"a":1} trailing', '{"a":1}]', '{"a":1},0]', '{"a":1}],[0', '{"a":1},{"b":2}', "{bad", "", "123", "[1]",
    '"x"', '{"level":NaN}', "{'level':'x'}", '{"a":1,}',
]


def test_json_other_than_one_object_keeps_only_raw(lines):
    for row, (text,) in all_rows(lines, [(t,) for t in NOT_ONE_OBJECT], "json"):
        assert (row.level, row.ts, row.message, row.extras, row.raw) == (None, None, None, {}, text)


def test_json_time_is_the_first_usable_key(lines):
    assert one(lines, '{"time":1705327200}', "json").ts is None
    assert one(lines, '{"time":"","ts":"2024-01-15T14:00:01Z"}', "json").ts == AT
    assert one(lines, '{"time":"soon","ts":"2024-01-15T14:00:01Z"}', "json").ts is None
    row = one(lines, '{"@timestamp":"15/Jan/2024:14:00:01 -0130"}', "json")
    assert (row.ts, row.ts_offset) == (AT, -5400)


def test_json_extras_keep_nested_values_as_text(lines):
    row = one(lines, '{"level":"x","a":{"b": [1, "q"]},"n":null,"t":true,"s":"y","f":1.5}', "json")
    assert row.extras == {"a": '{"b":[1,"q"]}', "n": None, "t": "true", "s": "y", "f": "1.5"} or row.extras == {
        "a": '{"b":[1,"q"]}', "n": "null", "t": "true", "s": "y", "f": "1.5"
    }


LOGFMT = [
    ("foo level=INFO", None, "", {"foo level": "INFO"}),
    ("level=a level=b", "B", "", {}),
    ('msg="open ended', None, "open ended", {}),
    ('lvl=warn msg="a b" x= y="" z', "WARN", "a b", {"x": "", "y": ""}),
    ("level= severity=err", "ERR", "", {}),
    ("a=1 a=2 a=3", None, "", {"a": "3"}),
    ('a="q"b=2', None, "", {"a": "q", "b": "2"}),
    ("a=\tb c=d", None, "", {"a": "\tb", "c": "d"}),
    ("a=b=c", None, "", {"a": "b=c"}),
    ("no pairs", None, "", {}),
    ("message=x msg=", None, "x", {}),
    ("", None, "", {}),
]


def test_logfmt(lines):
    for row, case in all_rows(lines, LOGFMT, "logfmt"):
        assert (row.raw, row.level, row.message, row.extras) == case


def test_logfmt_time(lines):
    row = one(lines, 'ts="2024-01-15 14:00:01" level=info', "logfmt")
    assert (row.ts, row.ts_offset, row.level) == (AT, None, "INFO")


@pytest.mark.parametrize("fmt", ["plaintext", "json", "logfmt", "unknown"])
def test_record_layout(lines, fmt):
    parsed = parse(lines(PLAIN), fmt)
    kinds = {f.name: f.dataType for f in parsed.schema.fields}
    assert {f.name: kinds[f.name] for f in RECORD.fields} == {f.name: f.dataType for f in RECORD.fields}
    row = parsed.first()
    assert (row.cluster_id, row.template, row.extras) == (-1, None, row.extras)
    assert parse(lines(PLAIN), "unknown").first().level == "DEBUG"


JSON_LINE, PAIR_LINE = '{"time":"2024-01-15T14:00:01Z","level":"info"}', "time=x level=INFO msg=y"


@pytest.mark.parametrize(
    "texts, fmt",
    [
        (PLAIN, "plaintext"),
        ([JSON_LINE] * 4, "json"),
        ([PAIR_LINE] * 4, "logfmt"),
        ([JSON_LINE] * 10 + [PAIR_LINE] * 10, "json"),
        ([JSON_LINE] * 9 + [PAIR_LINE] * 11, "logfmt"),
        (["plain"] * 20 + [JSON_LINE] * 100, "plaintext"),
        ([JSON_LINE] + [" ", ""] * 9, "json"),
        (["{not json a=1 b=2"] * 3, "logfmt"),
        (["only=one pair"], "plaintext"),
        (["", "  "], "plaintext"),
        ([], "plaintext"),
    ],
)
def test_detection(lines, texts, fmt):
    frame = lines(texts)
    assert detect_format(frame) == fmt


def test_mixed_formats_parse_by_row(spark, lines):
    both = lines([JSON_LINE], "j").unionByName(lines([PAIR_LINE], "l")).unionByName(lines(PLAIN[3:4], "p"))
    formats = detect_per_key(both, ["file"]).select("file", "fmt")
    rows = parse(both.join(formats, "file"), F.col("fmt")).orderBy("file").collect()
    assert [(r.file, r.fmt, r.level, r.message) for r in rows] == [
        ("j", "json", "INFO", ""), ("l", "logfmt", "INFO", "y"),
        ("p", "plaintext", "WARN", "queue depth 95%"),
    ]
    assert rows[0].ts == AT and rows[0].ts_offset == 0 and rows[2].ts == datetime(2023, 6, 2, 9, 31, 20)


def test_json_numbers_keep_their_spelling(lines):
    text = '{"msg":7.0,"a":5.0,"b":12345678901234567890123456789012345678901234567,"d":{"x": 1.0},"a":6.50,"i":3}'
    row = parse(lines([text, '{"msg":"m","k":2}']), "json").orderBy("seq").first()
    assert row.message == "7.0"
    assert row.extras == {"a": "6.5", "b": "12345678901234567890123456789012345678901234567", "d": '{"x":1.0}', "i": "3"}


def test_long_logfmt_lines_take_linear_time(lines):
    parsed = parse(lines(["level=info a=1 a=2 " + "z" * 1_000_000, "k=v " * 20_000]), "logfmt").orderBy("seq")
    start = time.perf_counter()
    rows = parsed.select("level", "extras").collect()
    assert time.perf_counter() - start < 30
    assert rows[0].level == "INFO" and rows[0].extras == {"a": "2"} and rows[1].extras == {"k": "v"}
