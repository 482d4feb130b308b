from datetime import datetime

from pyspark.sql import functions as F

from siftline.operators import summary as S
from siftline.operators.parse import parse


def report(df):
    return [tuple(r) for r in S.summary_report(df).collect()]


def test_report_of_plain_lines(plain):
    assert report(parse(plain)) == [
        ("total", "Total lines", "8"), ("level", "FATAL", "1"), ("level", "ERROR", "2"), ("level", "WARN", "1"),
        ("level", "INFO", "3"), ("level", "DEBUG", "1"), ("span", "From", "2023-06-02 09:30:00"),
        ("span", "To", "2023-06-02 09:40:00"),
    ]


def test_report_orders_other_levels_by_name_and_counts_rows_without_level(lines):
    texts = ['{"level":"zeta"}', '{"level":"alpha"}', '{"level":"trace"}', '{"level":"warning"}', '{"level":"warn"}', "{}", "x"]
    assert [r[1:] for r in report(parse(lines(texts), "json"))] == [
        ("Total lines", "7"), ("WARN", "1"), ("WARNING", "1"), ("TRACE", "1"), ("ALPHA", "1"), ("ZETA", "1"), ("(no level)", "2"),
    ]


def test_empty_input(lines):
    empty = parse(lines([]))
    assert report(empty) == [("total", "Total lines", "0")]
    row = S.summary(empty).first()
    assert (row.total, row.unparsed, row.n_levels, row.first_ts, row.last_ts) == (0, 0, 0, None, None)
    assert row.by_level == {}
    assert tuple(S.time_span(empty).first()) == (None, None)


def test_large_input_has_thousands_separators(large):
    parsed = parse(large)
    assert ("total", "Total lines", "10,000") in report(parsed)
    assert {r.level: r.n for r in S.count_by_level(parsed).collect()} == {
        "INFO": 5000, "WARN": 2500, "ERROR": 2500,
    }
    assert S.total_rows(large).first().total == 10_000
    assert tuple(S.severity_rollup(parsed).first()) == (2500, 2500)


def test_summary_counts_levels_in_order(lines):
    texts = ["2024-01-15T10:00:00+05:00 INFO a", "2024-01-15T10:00:00Z INFO b", "FATAL c", "INFO d", "WARN e", "none", "WARN f"]

    def by_level(df):  # in its own order, which a Python dict of a collected map does not keep
        return [tuple(e) for e in S.summary(df).selectExpr("map_entries(by_level) AS e").first().e]

    row = S.summary(parse(lines(texts))).first()
    assert by_level(parse(lines(texts))) == [("FATAL", 1), ("WARN", 2), ("INFO", 3)]
    assert (row.total, row.unparsed, row.n_levels) == (7, 1, 3)
    odd = parse(lines(['{"level":"zeta"}', '{"level":"alpha"}', '{"level":"error"}', '{"level":"zeta"}']), "json")
    assert by_level(odd) == [("ERROR", 1), ("ALPHA", 1), ("ZETA", 2)]


def test_span_compares_instants_and_shows_wall_clocks(lines):
    df = parse(lines([
        "2024-01-15T10:00:00+05:00 INFO a",  # 05:00 UTC
        "2024-01-15T08:00:00Z INFO b",
        "2024-01-15T07:00:00-06:00 INFO c",  # 13:00 UTC
        "2024-01-15 09:00:00 INFO d",
        "no time",
    ]))
    row = S.summary(df).first()
    assert (row.first_ts, row.last_ts) == (datetime(2024, 1, 15, 10), datetime(2024, 1, 15, 7))
    assert (row.total, row.unparsed, row.n_levels) == (5, 1, 1)
    assert S.unparsed_rows(df).first().unparsed == 1


def test_labels(spark):
    df = spark.createDataFrame([("a" * 53,), ("a" * 54,), ("é" * 54,), ("",)], "t STRING")
    got = [r[0] for r in df.select(S.label(F.col("t"))).collect()]
    assert got == ["a" * 53, "a" * 52 + "…", "é" * 52 + "…", ""]


def test_top_keeps_first_appearance_on_ties(lines):
    texts = ["b", "a", "c", "a", "b"] + [f"x{i}" for i in range(20)]
    got = S.top(S.count_texts(lines(texts), "raw")).collect()
    assert [(r.raw, r.n) for r in got] == [("b", 2), ("a", 2), ("c", 1)] + [(f"x{i}", 1) for i in range(7)]


def test_one_pass_over_the_data(large, capsys):
    S.summary_report(parse(large)).explain()
    plan = capsys.readouterr().out
    assert plan.count("Scan") - plan.count("Range") <= 2
    assert "SortAggregate" not in plan.split("rollup")[0] or plan.count("HashAggregate") >= 2


def test_report_ends_with_the_most_frequent_templates(lines):
    from siftline.operators import templates as T

    parsed = parse(lines(["INFO b 1", "INFO a x", "INFO b 2", "ERROR " + "y" * 60]))
    counts = T.template_counts(T.mine(parsed, "message"))
    got = [tuple(r) for r in S.summary_report(parsed, counts).collect()]
    assert got[0] == ("total", "Total lines", "4")
    assert got[-3:] == [("template", "b <*>", "2"), ("template", "a x", "1"), ("template", "y" * 52 + "…", "1")]
