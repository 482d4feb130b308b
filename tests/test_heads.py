import gzip
import uuid

import pytest
from pyspark.sql import functions as F

from siftline.operators.scan_report import stage_times
from siftline.operators.search import search, search_files
from siftline.sources import files
from siftline.sources.files import heads, read_lines

JSON = ['{"level": "ERROR", "msg": "disk"}', '{"level": "INFO", "msg": "up"}']
LOGFMT = ["level=ERROR msg=net at=7", "level=WARN msg=slow at=8"]
TEXT = ["", "2023-06-02 09:30:04 ERROR  plain line", "2023-06-02 09:30:05 INFO  other"]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.log").write_text("\n".join(JSON * 30) + "\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as out:
        out.write("\n".join(LOGFMT * 15))
    (tmp_path / "c [1].log").write_text("\n".join(TEXT))
    (tmp_path / "empty.log").write_text("")
    return str(tmp_path)


def test_first_lines_of_every_file(spark, folder):
    paths = [f"{folder}/a.log", f"{folder}/b*", f"{folder}/c*", f"{folder}/empty.log", f"{folder}/a.log"]
    got = {}
    for r in heads(spark, paths).orderBy("lineno").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.lineno, r.raw))
    want = {"a.log": (JSON * 30)[:20], "b*": (LOGFMT * 15)[:20], "c*": TEXT}
    assert got == {name: list(enumerate(texts, 1)) for name, texts in want.items()}
    few = heads(spark, paths, rows=3).groupBy("file").agg(F.max("lineno").alias("n")).collect()
    assert sorted(r.n for r in few) == [3, 3, 3]


def test_formats_of_files(spark, folder):
    for numbered in (True, False):
        found = search_files(spark, folder, numbered, per_file=True, levels=["ERROR"])
        names = ["file", "lineno", "seq", "raw"] if numbered else ["file", "raw"]
        assert found.columns[: len(names)] == names and "_format" not in found.columns
        assert sorted(found.groupBy("message").count().collect()) == [("disk", 30), ("net", 15), ("plain line", 1)]
    alone = search_files(spark, f"{folder}/a.log", per_file=True, levels=["ERROR"])
    assert alone.count() == 30 and alone.first().file == f"{folder}/a.log"


def test_first_file_decides_for_all(spark, folder):
    paths = [f"{folder}/empty.log", f"{folder}/b.log.gz", f"{folder}/a.log"]
    got = search_files(spark, paths, levels=["ERROR"])
    want = search(read_lines(spark, paths), levels=["ERROR"], fmt="logfmt")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert search_files(spark, paths, fmt="json", levels=["ERROR"]).count() == 30


def test_more_files_than_a_job_takes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILES_AT_ONCE", 3)
    for i in range(8):
        (tmp_path / f"{i}.log").write_text("".join(f"{i} {k}\n" for k in range(i + 1)))
    got = sorted((r.raw, r.lineno) for r in heads(spark, str(tmp_path), rows=2).collect())
    assert got == sorted((f"{i} {k}", k + 1) for i in range(8) for k in range(min(i + 1, 2)))


def test_no_lines(spark, folder):
    assert heads(spark, f"{folder}/empty.log").collect() == []
    assert search_files(spark, f"{folder}/empty.log", per_file=True, levels=["ERROR"]).collect() == []


def test_only_beginnings_are_read(spark, tmp_path):
    for i in range(3):
        with open(tmp_path / f"{i}.log", "w") as out:
            out.writelines(f"2023-06-02 09:30:04 ERROR  line {k} of a long file\n" for k in range(400_000))
    tag = uuid.uuid4().hex
    spark.sparkContext.addJobTag(tag)
    try:
        assert heads(spark, str(tmp_path)).count() == 60
    finally:
        spark.sparkContext.removeJobTag(tag)
    scan = stage_times(spark, tag)[0]
    assert scan.tasks == 3 and scan.input_rows == 60 and scan.input_bytes < 3 << 20  # of some 60 MB
