import os
from datetime import datetime, timezone

import pytest

from conftest import PLAIN
from siftline.operators.parse import parse
from siftline.operators.predicates import level_in
from siftline.operators.search import search
from siftline.operators.summary import count_by_level
from siftline.streaming import follow, versions


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(0, len(PLAIN), 3):
        (folder / f"{i}.log").write_text("\n".join(PLAIN[i : i + 3]) + "\n")
    return folder


def drain(found, tmp_path, fmt, name="o"):
    query = follow.start_sink(found, str(tmp_path / name), str(tmp_path / f"{name}-state"), fmt)
    query.awaitTermination()
    return query


@pytest.mark.parametrize("options", [dict(levels=["ERROR"]), dict(patterns="gateway", invert=True), dict(from_="2023-06-02 09:31:45")])
def test_stream_equals_batch(spark, plain, landed, tmp_path, options):
    found = follow.follow_search(follow.follow_lines(spark, str(landed), max_files_per_batch=1), **options)
    drain(found, tmp_path, "text")
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "o")).collect())
    assert got == sorted(r.raw for r in search(plain, **options).collect())


def test_json_and_csv_sinks(spark, landed, tmp_path):
    found = follow.follow_search(follow.follow_lines(spark, str(landed)), ["FATAL"])
    drain(found, tmp_path, "json", "j")
    (row,) = spark.read.json(str(tmp_path / "j")).collect()
    assert (row.ts, row.level, row.msg) == ("2023-06-02 09:33:10", "FATAL", "ledger volume is read-only")
    drain(found, tmp_path, "csv", "c")
    rows = spark.read.option("header", True).csv(str(tmp_path / "c")).collect()
    assert [r.msg for r in rows] == ["ledger volume is read-only"]
    with pytest.raises(ValueError):
        drain(found, tmp_path, "xml", "x")


def test_only_files_from_a_moment_on(spark, landed, tmp_path):
    for name in os.listdir(landed):
        os.utime(landed / name, (1_600_000_000, 1_600_000_000))
    (landed / "new.log").write_text("ERROR arrived later\n")
    since = datetime(2023, 1, 1, tzinfo=timezone.utc)
    drain(follow.follow_lines(spark, str(landed), since).select("raw"), tmp_path, "parquet")
    assert [r.raw for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ["ERROR arrived later"]


def test_a_restarted_query_continues_where_it_stopped(spark, landed, tmp_path):
    found = follow.follow_search(follow.follow_lines(spark, str(landed)), ["ERROR"])
    drain(found, tmp_path, "text")
    (landed / "new.log").write_text("ERROR more\nINFO less\n")
    drain(found, tmp_path, "text")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o")).collect()) == [PLAIN[1], PLAIN[6], "ERROR more"]


def test_live_summary_equals_batch(spark, plain, landed, tmp_path):
    parsed = parse(follow.follow_lines(spark, str(landed), max_files_per_batch=1))
    live = str(tmp_path / "live")
    follow.start_live_summary(parsed, live, str(tmp_path / "state")).awaitTermination()
    got = {r.level: r.n for r in follow.live_summary(spark, live).collect()}
    assert got == {r.level: r.n for r in count_by_level(parse(plain)).collect()}


def test_totals_cover_all_batches_whatever_history_is_kept(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(8):
        (folder / f"{i}.log").write_text("ERROR a\nINFO b\n")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    watcher = follow.watch_scans(spark)
    try:
        found = follow.observe_scan(parse(follow.follow_lines(spark, str(folder), max_files_per_batch=1)), level_in(["ERROR"]))
        query = drain(found, tmp_path, "text")
        assert len(query.recentProgress) <= 3
        assert watcher.totals(query) == {"scanned": 16, "matched": 8}
    finally:
        spark.streams.removeListener(watcher)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_late_files_with_an_old_time_are_read(spark, landed, tmp_path):
    found = follow.follow_lines(spark, str(landed)).select("raw")
    drain(found, tmp_path, "parquet")
    (landed / "late.log").write_text("ERROR old\n")
    os.utime(landed / "late.log", (1_600_000_000, 1_600_000_000))
    drain(found, tmp_path, "parquet")
    assert "ERROR old" in {r.raw for r in spark.read.parquet(str(tmp_path / "o")).collect()}


def test_from_now_on_leaves_out_what_was_there_and_nothing_else(spark, landed, tmp_path):
    place = str(tmp_path / "known")
    before = {r.file.rsplit("/", 1)[1] for r in follow.known_files(spark, str(landed), place).collect()}
    assert before == set(os.listdir(landed))
    (landed / "old.log").write_text("ERROR late with an old time\n")
    os.utime(landed / "old.log", (1_600_000_000, 1_600_000_000))
    for line in ("ERROR one", "ERROR two"):  # the second run starts again from the checkpoint
        (landed / f"{line[-3:]}.log").write_text(line + "\n")
        known = follow.known_files(spark, str(landed), place)
        drain(follow.follow_lines(spark, str(landed), known=known).select("raw"), tmp_path, "parquet")
    got = sorted(r.raw for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == ["ERROR late with an old time", "ERROR one", "ERROR two"]


def test_counters_outlive_the_query_and_repeated_batches(spark, landed, tmp_path):
    out, ledger, state = (str(tmp_path / x) for x in ("o", "ledger", "state"))

    def run():
        parsed = parse(follow.follow_lines(spark, str(landed), max_files_per_batch=1))
        follow.start_counted_search(parsed, level_in(["ERROR"]), out, ledger, state).awaitTermination()
        return follow.scan_ledger(spark, ledger).collect()

    (first,) = run()
    assert (first.scanned, first.matched) == (len(PLAIN), 2)
    (landed / "new.log").write_text("ERROR more\nINFO less\n")
    (second,) = run()
    assert (second.query, second.scanned, second.matched) == (first.query, len(PLAIN) + 2, 3)
    # as if the driver had died before the last batch was committed
    commits = tmp_path / "state" / "commits"
    last = max((int(n) for n in os.listdir(commits) if n.isdigit()))
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink()
    (third,) = run()
    assert (third.scanned, third.matched, third.batch) == (second.scanned, second.matched, second.batch)
    assert sorted(r.raw for r in spark.read.parquet(out).collect()) == sorted([PLAIN[1], PLAIN[6], "ERROR more"])


def test_versions_are_bounded_and_read_whole(spark, tmp_path):
    place = str(tmp_path / "v")
    assert versions.read(spark, place, "a INT").collect() == []
    for i in range(12):
        reading = versions.read(spark, place, "a INT, b INT")
        versions.publish(spark.createDataFrame([(i, j) for j in range(5)], "a INT, b INT"), place, i)
        assert {r.a for r in reading.collect()} == ({i - 1} if i else set())
    assert len([n for n in os.listdir(place) if n.startswith("version")]) <= versions.KEPT
    assert sorted(map(tuple, versions.read(spark, place, "a INT, b INT").collect())) == [(11, j) for j in range(5)]


def test_live_summary_has_a_bounded_number_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(15):
        (folder / f"{i}.log").write_text("ERROR a\nINFO b\n")
    live = str(tmp_path / "live")
    parsed = parse(follow.follow_lines(spark, str(folder), max_files_per_batch=1))
    follow.start_live_summary(parsed, live, str(tmp_path / "state")).awaitTermination()
    assert {r.level: r.n for r in follow.live_summary(spark, live).collect()} == {"ERROR": 15, "INFO": 15}
    assert sum(len(files) for _, _, files in os.walk(live)) <= 6 * versions.KEPT
