import gzip
import hashlib
import random

import pytest

from tallycard.llm import warc
from tallycard.session import scratch_path

PAGES = "page_id bigint, url string, html string, path string, payload string, digest int"


def test_ranges_of_any_size():
    rng = random.Random(1)
    data = b"".join(warc._member(i, "http://x", rng.randbytes(rng.randint(0, 5000)) + b"a" * rng.randint(0, 9000) + warc.MAGIC * 3, "d", None, 4) for i in range(120))
    data = data[:40] + data  # a damaged member first

    class Source:
        def size(self):
            return len(data)

        def read_at(self, n, at):
            return data[at:at + n]

    for split in (997, 7777, 1 << 20):
        got = [r for at in range(0, len(data), split) for r in warc._scan(Source(), "p", at, at + split, 4096)]
        assert [r[4] for r in got] == [str(i) for i in range(120)]


def test_stored_members_inside_a_member_are_not_records():
    inner = warc._member(5, None, b"z", "d", None, 4)
    data = warc._member(1, None, inner * 3, "d", None, 4) + warc._member(2, None, b"", "d", None, 4)

    class Source:
        def size(self):
            return len(data)

        def read_at(self, n, at):
            return data[at:at + n]

    assert [r[4] for r in warc._scan(Source(), "p", 0, len(data), 512)] == ["1", "2"]


def test_write_and_read(spark):
    big, other = "x" * 1500, "y" * 1500
    rows = [(1, "u", big), (2, None, big), (3, "a\r\nb", other), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", big), (8, "u", big), (8, "u", big),
            (9, "u", "\u00e9" * 500), (10, "u", "\u00e9" * 500)]
    pages = spark.createDataFrame([(*r, "p", "q", 1) for r in rows], PAGES).repartition(3)
    folder = scratch_path(spark, "warc")
    manifest = warc.write_archives(pages, folder)
    got = warc.read_archives(manifest, split_bytes=700).collect()
    assert len(got) == len(rows) and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    listed = warc.read_archives(warc.list_archives(spark, folder), split_bytes=10 ** 6)
    assert listed.count() == len(rows)
    kinds = {(r["record_id"], r["record_type"], r["refers_to"]) for r in got}
    assert {("8", "response", None), ("1", "revisit", "8"), ("2", "revisit", "8"), (None, "revisit", "8"), ("9", "revisit", "10"), ("6", "response", None)} <= kinds
    for r in got:
        if r["payload"] is not None:
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["http_length"]
    one = manifest.first()["path"].removeprefix("file:")
    assert gzip.open(one).read().startswith(b"WARC/1.1")


def test_empty(spark):
    manifest = warc.write_archives(spark.createDataFrame([], PAGES), scratch_path(spark, "warc"))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


def test_damaged_archives_fail(spark, small, monkeypatch):
    """A cut archive, or one with a broken member, must not give fewer pages in silence."""
    whole = warc.op9_warc(spark, small)
    assert whole.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert whole.count() == spark.read.parquet(f"{small}/pages.parquet").count()
    write = warc.write_archives

    def damaged(change):
        def fn(*args, **named):
            manifest = write(*args, **named)
            path = manifest.first()["path"].removeprefix("file:")
            with open(path, "rb") as f:
                data = f.read()
            with open(path, "wb") as f:
                f.write(change(data))
            return manifest

        return fn

    for change in (lambda d: d[:-20], lambda d: d[:30] + bytes(40) + d[70:]):
        monkeypatch.setattr(warc, "write_archives", damaged(change))
        with pytest.raises(ValueError, match="damaged or cut short"):
            warc.op9_warc(spark, small)
