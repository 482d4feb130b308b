import re

import pytest
from pyspark.sql import functions as F

from conftest import PLAIN
from siftline.functions import patterns as P
from siftline.operators import predicates
from siftline.operators.parse import parse
from siftline.operators.search import counted, scan_rate, search


def found(df):
    return [r.lineno for r in df.orderBy("seq").select("lineno").collect()]


@pytest.mark.parametrize(
    "options, expected",
    [
        (dict(levels=["ERROR"]), [2, 7]),
        (dict(levels=["error", "Warn"]), [2, 4, 7]),
        (dict(levels=["TRACE"]), []),
        (dict(levels=["INFO"]), [3, 5, 8]),
        (dict(patterns="Gateway"), [2, 5, 7]),
        (dict(patterns=r"ERROR.*west:\d+"), [2, 7]),
        (dict(patterns=["ledger", "DEPTH"]), [4, 6]),
        (dict(patterns=["ledger", r"^\d+.*95%$"]), [4, 6]),
        (dict(patterns=""), [1, 2, 3, 4, 5, 6, 7, 8]),
        (dict(patterns="unreachable via", regex_mode=True), [2, 7]),
        (dict(to="2023-06-02 09:30:04"), [1, 2, 3]),
        (dict(from_="2023-06-02 09:30:04", to="2023-06-02T09:31:45+05:00"), [2, 3, 4, 5]),
        (dict(from_="2023-06-02 09:33:10"), [6, 7, 8]),
        (dict(levels=["ERROR"], patterns="gateway", from_="2023-06-02 09:31:00"), [7]),
        (dict(), [1, 2, 3, 4, 5, 6, 7, 8]),
    ],
)
def test_search_and_its_inverse(plain, options, expected):
    assert found(search(plain, **options)) == expected
    assert found(search(plain, invert=True, **options)) == [i for i in range(1, 9) if i not in expected]


def test_large_input(large):
    assert search(large, ["ERROR"]).count() == 2500


def test_rows_without_level_or_time_fail_filters_and_pass_inverted_ones(lines):
    df = lines(["no level here", "2024-01-15 14:00:01 ERROR x"])
    assert found(search(df, ["ERROR"])) == [2]
    assert found(search(df, ["ERROR"], invert=True)) == [1]
    assert found(search(df, from_="2000-01-01 00:00:00", invert=True)) == [1]


@pytest.mark.parametrize("fmt", ["json", "logfmt", None])
def test_formats(lines, fmt):
    json_lines = ['{"level":"error","msg":"refused"}', '{"level":"debug","msg":"x"}', '{"level":"warning"}']
    pairs = ['level=ERROR msg="refused"', "level=debug msg=x", "level=warning msg=y"]
    df = lines(pairs if fmt == "logfmt" else json_lines)
    assert found(search(df, ["ERROR"], fmt=fmt)) == [1]
    assert found(search(df, ["WARN"], fmt=fmt)) == []
    assert found(search(df, ["WARNING"], fmt=fmt)) == [3]


def test_level_test_agrees_with_level_column(lines):
    odd = ["crıtıcal x", "İNFO y", "ınfo", "errors", "an Error", "warning", "WARN", "trace/debug", "informal"]
    df = lines(odd)
    for level in ("CRITICAL", "INFO", "ERROR", "WARN", "TRACE", "DEBUG", "FATAL"):
        by_column = found(parse(df).where(F.col("level") == level))
        assert found(search(df, [level])) == by_column


@pytest.mark.parametrize("pattern", ["[invalid", "(", "*x", "a{2,1}"])
def test_invalid_pattern_is_refused_when_the_query_is_built(plain, pattern):
    with pytest.raises(ValueError, match="invalid pattern"):
        search(plain, patterns=pattern)
    with pytest.raises(ValueError):
        search(plain, patterns=["fine", pattern])


@pytest.mark.parametrize("bound", ["2024-01-15 14:00", "not-a-date"])
def test_invalid_bound_is_refused(plain, bound):
    with pytest.raises(ValueError):
        search(plain, from_=bound)


def test_literal_check():
    assert P.is_literal("connection refused") and P.is_literal("")
    assert not any(P.is_literal(p) for p in ["a.b", "err*", "[ERROR]", "a|b", "a\\b", "(x)", "x$"])


PYTHON_SPELLINGS = [
    r"(?P<w>\w)(?P=w)", r"(?P<a_b>x)y(?P=a_b)", r"end\Z", r"[[x]y", r"[a&&b]", r"[]x]", r"[^]x]+", r"\d{2,}$",
    r"a.c", r"(?i:ABC)", r"\bé\w+\b", r"[\]\[]", r"x(?=y)", r"(?<!x)y",
    '{"level":', "foo{bar}", "x{", r"\${HOME}", "a{,3}b", "a{2}", "a{2,}", "a{1,2}b", "{}", "a{}", "a{3", "[{]", r"\{",
    r"(?a)é\w", r"(?u)é\w", r"(?ia:é\w)",
]
SUBJECTS = [
    "aa bb", "xyx", "the end", "[y x", "a&b", "]", "12 345", "a c", "abc", "élan", "xy", "y", "", "x]y",
    '{"level":1', "foo{bar}", "x{", "${HOME}", "aaab", "aa", "{}", "a{}", "a{3", "éa", "éé",
]


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_patterns_mean_what_they_mean_in_python(lines):
    columns = [predicates.matches(p).alias(f"p{i}") for i, p in enumerate(PYTHON_SPELLINGS)]
    rows = lines(SUBJECTS).orderBy("seq").select(*columns).collect()
    for i, pattern in enumerate(PYTHON_SPELLINGS):
        want = [bool(re.search(pattern, s, re.IGNORECASE)) for s in SUBJECTS]
        assert [r[i] for r in rows] == want, pattern


def test_many_literals(lines):
    df = lines(["alpha", "Beta", "gamma"])
    words = [f"word{i}" for i in range(40)] + ["BETA"]
    assert found(df.where(predicates.matches(words))) == [2]


def test_python_predicate(plain):
    even = predicates.python_predicate(lambda line: len(line) % 2 == 0)
    want = [i for i, t in enumerate(PLAIN, 1) if len(t) % 2 == 0]
    assert found(search(plain, extra=[even(F.col("raw"))])) == want


def test_counters_fill_while_rows_are_written(plain):
    rows, seen = counted(parse(plain), predicates.level_in(["ERROR"]))
    assert rows.count() == 2
    assert (seen.get["scanned"], seen.get["matched"]) == (8, 2)
    assert scan_rate(100, 0.5) == 200 and scan_rate(5, 0) == 0


def test_pattern_search_filters_before_parsing(plain, capsys):
    search(plain, patterns="gateway", fmt="json").explain()
    plan = capsys.readouterr().out
    assert plan.index("try_parse_json") < plan.index("contains(lower(raw") if "try_parse_json" in plan else True
    assert "Exchange" not in plan


def test_stored_records_push_filters_down(spark, plain, tmp_path, capsys):
    parse(plain).write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    stored.where(predicates.build(["ERROR"], from_="2024-01-15 14:00:00")).select("raw").explain()
    plan = capsys.readouterr().out
    assert "EqualTo(level,ERROR)" in plan.replace(" ", "") or "In(level" in plan
    assert "GreaterThanOrEqual(ts" in plan


def test_format_is_detected_by_default_also_per_file_and_without_numbers(lines):
    json_lines = lines(['{"level":"error","msg":"x"}', '{"level":"info"}'], "a")
    pair_lines = lines(["level=error msg=y", "level=info msg=z"], "b")
    assert found(search(json_lines, ["ERROR"])) == [1]
    assert search(json_lines.select("raw"), ["ERROR"]).count() == 1
    both = json_lines.unionByName(pair_lines).unionByName(lines(["ERROR plain", "nothing"], "c"))
    got = search(both, ["ERROR"], per_file=True)
    assert sorted((r.file, r.lineno) for r in got.collect()) == [("a", 1), ("b", 1), ("c", 1)]
    assert "_format" not in got.columns and "_of" not in got.columns
