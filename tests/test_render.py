import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from siftline.operators import render as R
from siftline.operators.context import context
from siftline.operators.parse import parse
from siftline.operators.predicates import level_in
from siftline.operators.search import search


def written(path):
    return [line for p in sorted(glob.glob(f"{path}/part-*")) for line in open(p, newline="").read().split("\n")[:-1]]


def test_text_sink_with_and_without_prefix(plain, tmp_path):
    found = search(plain, ["ERROR"])
    R.write_matches(found, str(tmp_path / "bare"), "text", order="seq")
    assert written(tmp_path / "bare") == [
        "2023-06-02 09:30:04 ERROR  payment gateway unreachable via eu-west:7001",
        "2023-06-02 09:33:11 ERROR  payment gateway unreachable via eu-west:7002",
    ]
    R.write_matches(found, str(tmp_path / "full"), "TEXT", show_file=True, show_lineno=True, order="seq", tag=True, patterns=["west"])
    assert written(tmp_path / "full")[0] == (
        "app.log:2:[ERROR] 2023-06-02 09:30:04 ERROR  payment gateway unreachable via eu-<<west>>:7001"
    )


def test_prefix_parts(spark):
    df = spark.createDataFrame([("a.log", 3), ("-", 3), (None, None)], "f STRING, n BIGINT")
    both = [r[0] for r in df.select(R.prefix(F.col("f"), F.col("n"))).collect()]
    assert both == ["a.log:3:", "3:", ""]
    assert [r[0] for r in df.select(R.prefix()).collect()] == ["", "", ""]


def test_json_sink(lines, tmp_path):
    df = parse(lines(['{"level":"error","msg":"a \\"q\\" é","time":"2024-01-15T14:00:01.5Z"}', '{"msg":""}']), "json")
    R.write_matches(df, str(tmp_path / "j"), "json", order="seq")
    got = [json.loads(t) for t in written(tmp_path / "j")]
    assert got[0] == {"ts": "2024-01-15 14:00:01.500000+00:00", "level": "ERROR", "msg": 'a "q" é', "file": None, "lineno": None}
    assert got[1] == {"ts": None, "level": None, "msg": '{"msg":""}', "file": None, "lineno": None}
    assert list(got[0]) == ["ts", "level", "msg", "file", "lineno"]


def test_csv_sink(lines, tmp_path):
    df = parse(lines(['ERROR  say "hi", a\\b', "INFO - x ", "  plain  "]))
    R.write_matches(df.coalesce(1), str(tmp_path / "c"), "csv", show_file=True, show_lineno=True)
    (path,) = glob.glob(f"{tmp_path}/c/part-*")
    assert list(csv.reader(open(path))) == [
        ["ts", "level", "msg", "file", "lineno"],
        ["", "ERROR", 'say "hi", a\\b', "app.log", "1"],
        ["", "INFO", "x ", "app.log", "2"],
        ["", "", "  plain  ", "app.log", "3"],
    ]
    R.write_matches(df.where("false"), str(tmp_path / "none"), "csv")
    assert written(tmp_path / "none") in ([], ["ts,level,msg,file,lineno"])


def test_unknown_format(plain, tmp_path):
    with pytest.raises(ValueError):
        R.write_matches(parse(plain), str(tmp_path / "x"), "xml")


def test_separators_between_groups(lines, tmp_path):
    texts = ["INFO 1", "ERROR 2", "INFO 3", "INFO 4", "INFO 5", "ERROR 6", "INFO 7"]
    near = context(parse(lines(texts)), level_in(["ERROR"]), 1)
    R.write_matches(near, str(tmp_path / "t"), "text", order="seq")
    assert written(tmp_path / "t") == texts[:3] + ["--"] + texts[4:]
    R.write_matches(near, str(tmp_path / "j"), "json", order="seq")
    assert [json.loads(t)["group_id"] for t in written(tmp_path / "j")] == [0, 0, 0, 1, 1, 1]


def test_level_tag(spark):
    df = spark.createDataFrame([("ERROR",), ("WARNING",), ("NOTICE",), (None,)], "level STRING")
    assert [r[0] for r in df.select(R.level_tag(F.col("level"))).collect()] == ["[ERROR] ", "[WARNING] ", "", ""]


def test_highlight(spark):
    df = spark.createDataFrame([("Abc a.c 1",)], "raw STRING")
    raw = F.col("raw")
    got = df.select(
        R.highlight(raw, ["a.c", r"\d"]), R.highlight(raw, []), R.highlight(raw, ["[bad"]),
        R.highlight(raw, ["abc"], "$1\\", "\x1b[0m"),
    ).first()
    assert tuple(got) == ("<<Abc>> <<a.c>> <<1>>", "Abc a.c 1", "Abc a.c 1", "$1\\Abc\x1b[0m a.c 1")
