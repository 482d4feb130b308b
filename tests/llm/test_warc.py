import base64
import gzip
import hashlib
import io
import random

import pytest

from siftline.llm import warc
from siftline.session import work_folder

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    out = []
    for page, url, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        first = min(same) if same and len(payload) >= least else None
        revisit = first is not None and page != first
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "revisit" if revisit else "response", first if revisit else None, None if revisit else payload))
    return sorted(out, key=repr)


def round_trip(spark, frame, params=warc.Archives()):
    folder = work_folder(spark, "archives")
    files = warc.write_archives(frame, params, folder)
    rows = warc.read_archives(files, folder).collect()
    return files, sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows), key=repr), rows


@pytest.mark.parametrize("params", [warc.Archives(), warc.Archives(file_bytes=2000, least_revisit=5)])
def test_round_trip(spark, params):
    rnd = random.Random(1)
    bodies = [None, "", "é", "<p>same</p>", "WARC/1.1\r\n\r\n", "x" * 3_000_000, "\r\n\r\n", "a\0b"]
    rows = [(i, f"http://x/{i}", rnd.choice(bodies)) for i in range(60)]
    rows += [(60, None, "u"), (61, "http://x/\r\nEvil: 1", "v"), (None, "n", "<p>same</p>"), (None, "n", "alone"), (5, "again", rows[5][2])]
    frame = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA + ", sha1 string").repartition(4)
    files, got, records = round_trip(spark, frame, params)
    assert got == brute(rows, params.least_revisit)
    assert sum(r.records for r in files.collect()) == len(rows)
    if params.file_bytes == 2000:
        assert files.count() > 4
    assert {r.url for r in records if r.page_id in (60, 61)} == {None, "http://x/%0D%0AEvil: 1"}


def test_members_are_records_that_any_gzip_reader_takes(spark):
    folder = work_folder(spark, "archives")
    files = warc.write_archives(spark.createDataFrame([(1, "u", "one"), (2, "v", "one")], SCHEMA).coalesce(1), folder=folder)
    (path,) = [r.path for r in files.collect()]
    data = open(path, "rb").read()
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 2
    assert data.count(b"\x1f\x8b\x08") == 2


class Slow(io.BytesIO):
    """Gives few bytes at a time."""

    def read(self, size=-1):
        return super().read(min(size, 7))


def archive(*records, cut=0):
    data = b"".join(gzip.compress(r) for r in records)
    return Slow(data[: len(data) - cut])


def one(payload=b"hello", **change):
    sha1 = hashlib.sha1(payload).digest()
    return warc.record(1, "u", payload, change.get("sha1", sha1), False, None, "1970-01-01T00:00:00Z")


def test_damage_is_noticed():
    good = one()
    assert [r["payload"] for r in warc.read_records(archive(good, one(b"")))] == [b"hello", b""]
    bad = [
        archive(good, cut=3),
        archive(one(sha1=b"0" * 20)),
        archive(good.replace(b"hello", b"hallo")),
        archive(good[:-1]),
        archive(good + b"x"),
        archive(good + good),
        archive(b"HTTP/1.1\r\n\r\n"),
        archive(good[:20]),
    ]
    for file in bad:
        with pytest.raises(ValueError):
            list(warc.read_records(file))


def test_empty_table(spark):
    files, got, _ = round_trip(spark, spark.createDataFrame([], SCHEMA))
    assert files.collect() == [] and got == []
