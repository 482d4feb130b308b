from pyspark.sql import functions as F

from siftline.operators.parse import parse
from siftline.operators.predicates import build
from siftline.operators.scan_report import run_scan
from siftline.sources.files import read_lines


def discard(frame):
    frame.write.format("noop").mode("overwrite").save()


def test_counts_time_and_rate(spark, large):
    report = run_scan(parse(large), build(levels=["ERROR"]), discard)
    assert (report.scanned, report.matched) == (10_000, 2_500)
    assert report.seconds > 0 and report.rows_per_second == int(10_000 / report.seconds)
    row = report.frame(spark).first()
    assert (row.scanned, row.matched, row.elapsed, row.rows_per_second) == (10_000, 2_500, report.seconds, report.rows_per_second)


def test_stages_are_those_of_the_scan(spark, large, tmp_path):
    large.select("raw").repartition(3).write.text(f"{tmp_path}/in")
    lines = read_lines(spark, f"{tmp_path}/in", numbered=False)
    other = spark.range(10).repartition(2)
    other.count()
    taken = []
    report = run_scan(parse(lines), build(patterns="shard 77 "), lambda f: taken.append(f.select("raw").collect()))
    other.count()
    assert [r.raw.split()[4] for r in taken[0]] == ["77"]
    assert len(report.stages) == 1
    only = report.stages[0]
    assert only.input_rows == 10_000 and only.input_bytes > 100_000
    assert only.tasks >= 1 and 0 <= only.seconds <= report.seconds + 1 and only.task_seconds > 0
    assert [tuple(r) for r in report.stage_frame(spark).collect()] == [
        (only.stage, only.tasks, only.seconds, only.task_seconds, only.input_bytes, only.input_rows)
    ]


def test_a_shuffle_is_a_stage_of_its_own(spark, large):
    report = run_scan(parse(large), build(levels=["WARN"]), lambda f: discard(f.groupBy("level").agg(F.count("*"))))
    assert report.matched == 2_500 and len(report.stages) == 2


def test_tag_goes_also_when_the_action_fails(spark, plain):
    def fail(frame):
        raise RuntimeError("no sink")

    before = spark.sparkContext.getJobTags()
    try:
        run_scan(parse(plain), build(levels=["ERROR"]), fail)
    except RuntimeError:
        pass
    assert spark.sparkContext.getJobTags() == before


def test_no_lines(spark):
    report = run_scan(parse(spark.createDataFrame([], "raw STRING")), build(levels=["ERROR"]), discard)
    assert (report.scanned, report.matched, report.rows_per_second) == (0, 0, 0)
