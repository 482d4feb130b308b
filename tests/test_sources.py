import bz2
import gzip

import pytest

from conftest import PLAIN
from siftline.operators.numbering import number_rows
from siftline.operators.parse import detect_format
from siftline.session import release, stage, staged_so_far
from siftline.sources import files
from siftline.sources.files import expand, head, read_lines
from siftline.sources.tables import lines_from_table


def rows(df):
    return [tuple(r) for r in df.orderBy("seq").select("lineno", "seq", "raw").collect()]


def brute(texts_per_file):
    out, seq = [], 0
    for texts in texts_per_file:
        for i, t in enumerate(texts, 1):
            seq += 1
            out.append((i, seq, t))
    return out


def test_line_ends_blank_lines_and_bad_bytes(spark, tmp_path):
    p = tmp_path / "a b%20[1] é.log"
    p.write_bytes(b"one\r\ntwo\rthree\n\nbad \xff\xfe end\nlast \xc3\xa9")
    got = read_lines(spark, str(p))
    assert rows(got) == brute([["one", "two", "three", "", "bad �� end", "last é"]])
    assert {r.file for r in got.select("file").collect()} == {str(p)}
    twice = read_lines(spark, [str(p), str(p)], numbered=False)
    assert {r.file for r in twice.select("file").collect()} == {str(p)} and twice.count() == 12


def test_compressed_files(spark, tmp_path):
    text = "\n".join(PLAIN) + "\n"
    (tmp_path / "x.log").write_text(text)
    (tmp_path / "x.log.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "x.log.bz2").write_bytes(bz2.compress(text.encode()))
    names = [str(tmp_path / n) for n in ("x.log.gz", "x.log.bz2", "x.log")]
    assert rows(read_lines(spark, names)) == brute([PLAIN] * 3)


def test_argument_order_globs_and_repeated_files(spark, tmp_path):
    for name, texts in {"b.log": ["b1", "b2"], "a.log": ["a1"], "c.txt": ["c1", "c2", "c3"], ".hid.log": ["h"]}.items():
        (tmp_path / name).write_text("\n".join(texts))
    got = read_lines(spark, [f"{tmp_path}/c.txt", f"{tmp_path}/*.log", f"{tmp_path}/c.txt"])
    assert rows(got) == brute([["c1", "c2", "c3"], ["a1"], ["b1", "b2"], ["c1", "c2", "c3"]])
    assert [f.name for f in expand(spark, f"{tmp_path}/*.log")] == [f"{tmp_path}/a.log", f"{tmp_path}/b.log"]
    folder = read_lines(spark, str(tmp_path), numbered=False)
    assert sorted(r.raw for r in folder.collect()) == ["a1", "b1", "b2", "c1", "c2", "c3"]
    with pytest.raises(FileNotFoundError):
        read_lines(spark, f"{tmp_path}/none-*.log")


def test_empty_file(spark, tmp_path):
    (tmp_path / "empty.log").write_text("")
    assert rows(read_lines(spark, str(tmp_path / "empty.log"))) == []
    assert detect_format(head(spark, str(tmp_path / "empty.log"))) == "plaintext"


@pytest.mark.parametrize("broadcast", [True, False])
def test_numbers_over_many_splits(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(files, "MAX_BROADCAST_SPLITS", 0)
    big = [f"line {i} " + "x" * (i % 90) for i in range(5000)]
    (tmp_path / "big.log").write_text("\n".join(big))
    (tmp_path / "small.log").write_text("s1\ns2\n")
    (tmp_path / "z.log.bz2").write_bytes(bz2.compress("\n".join(big[:500]).encode()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        names = [str(tmp_path / n) for n in ("big.log", "small.log", "big.log", "z.log.bz2")]
        got = read_lines(spark, names)
        assert rows(got) == brute([big, ["s1", "s2"], big, big[:500]])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_changed_split_layout_stops_the_job(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("\n".join(f"line {i}" for i in range(5000)))
    numbered = read_lines(spark, str(path))
    with open(path, "a") as f:
        f.write("\nmore\nlines")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000b")
    try:
        for frame in (numbered, numbered.where("seq > 10"), numbered.where("seq is not null").select("raw")):
            with pytest.raises(Exception, match="split differently"):
                frame.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_head_reads_on_until_it_has_enough(spark, tmp_path):
    (tmp_path / "a.log").write_text("a\n")
    (tmp_path / "b.log").write_text("")
    (tmp_path / "c.log").write_text("\n".join(f"c{i}" for i in range(50)))
    got = head(spark, f"{tmp_path}/*.log").orderBy("seq").collect()
    assert [r.raw for r in got] == ["a"] + [f"c{i}" for i in range(19)]


def test_lines_from_table(spark):
    texts = {1: "a\nb\r\nc\rd", 2: "", 3: None, 4: "\n", 5: "x\n", 6: "x\n\n", 7: "one"}
    df = spark.createDataFrame(list(texts.items()), "k INT, t STRING")
    got = [tuple(r) for r in lines_from_table(df, "t", ["k"]).orderBy("k", "lineno").collect()]
    assert got == [
        (1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d"), (4, 1, ""), (5, 1, "x"), (6, 1, "x"), (6, 2, ""), (7, 1, "one"),
    ]


@pytest.mark.parametrize("chunk_rows", [1, 7, 1000])
def test_row_numbers_with_a_key_holding_most_rows(spark, chunk_rows):
    data = [("hot" if i % 10 else f"k{i % 3}", 3 * i + 5) for i in range(500)]
    df = spark.createDataFrame(data, "k STRING, pos BIGINT")
    got = {(r.k, r.pos): (r.lineno, r.seq) for r in number_rows(df, "pos", ["k"], chunk_rows=chunk_rows).collect()}
    want, seq = {}, 0
    for key in sorted({k for k, _ in data}):
        for i, pos in enumerate(sorted(p for k, p in data if k == key), 1):
            seq += 1
            want[(key, pos)] = (i, seq)
    assert got == want


@pytest.mark.parametrize("name", ["_app.log", ".app.log"])
def test_hidden_names_are_refused_not_skipped(spark, tmp_path, name):
    (tmp_path / name).write_text("a\n")
    (tmp_path / "app.log").write_text("b\n")
    for paths in (str(tmp_path / name), [str(tmp_path / "app.log"), str(tmp_path / name)]):
        with pytest.raises(ValueError, match="does not read"):
            read_lines(spark, paths)
    assert [r.raw for r in read_lines(spark, str(tmp_path)).collect()] == ["b"]


def test_large_gzip_is_spread_alone(spark, tmp_path, monkeypatch):
    from siftline.sources import files

    monkeypatch.setattr(files, "SPREAD_BYTES", 10)
    with gzip.open(tmp_path / "a.log.gz", "wt") as f:
        f.write("x\ny\n")
    (tmp_path / "b.log").write_text("z\n")
    for numbered in (True, False):
        got = read_lines(spark, [str(tmp_path / "a.log.gz"), str(tmp_path / "b.log")], numbered)
        assert sorted(r.raw for r in got.collect()) == ["x", "y", "z"]


def test_release_deletes_what_a_later_table_replaces(spark):
    first = stage(spark.range(3).toDF("a"), "first")
    mark = staged_so_far(spark)
    second = stage(first.selectExpr("a + 1 AS a"), "second")
    third = stage(second.selectExpr("a * 2 AS a"), "third")
    release(spark, mark, third)
    assert sorted(r.a for r in third.collect()) == [2, 4, 6] and first.count() == 3
    with pytest.raises(Exception):
        second.count()
