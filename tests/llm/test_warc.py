import gzip
import hashlib
import io
import os

import pytest

from graphloom.llm import warc
from graphloom.llm.storage import new_dir

SCHEMA = "page_id long, url string, html string, note string"


@pytest.fixture(scope="module")
def pages(spark):
    nested = gzip.compress(warc.record_bytes(999, "u", b"inside", "0", None, False)).decode("latin-1")
    long, other = "<p>long page</p>" * 100, "é漢" * 600
    rows = [(0, "http://a/0", long), (1, "http://a/1", long), (7, "http://a/7", long), (2, None, None), (3, "u\r\nX: y", ""), (4, "u", "short"), (5, "u", "short"), (6, "u", other), (8, "u", nested * 3), (9, "u", other), (9, "u", other), (None, "n", long), (10, "u", "x" * 3_000_000)]
    return spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)


def read(spark, pages, split):
    path = new_dir(spark, "archives")
    warc.write_archives(pages, path)
    return warc.read_archives(spark, path, split).collect()


@pytest.mark.parametrize("split", [97, 5000, 1 << 23])
def test_round_trip(spark, pages, split):
    got = read(spark, pages.where("page_id is null or page_id < 10") if split == 97 else pages, split)
    want = pages.where("page_id is null or page_id < 10").collect() if split == 97 else pages.collect()
    assert len(got) == len(want)
    by_id = {r.page_id: r for r in want}
    for r in got:
        payload = (by_id[r.page_id].html or "").encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha1(payload).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[0] == kinds[1] == kinds[None] == ("revisit", 7) and kinds[7] == ("response", None)
    assert kinds[6] == ("revisit", 9) and kinds[9] == ("response", None)
    assert kinds[4] == kinds[5] == kinds[2] == ("response", None)


def test_empty_table(spark, pages):
    assert read(spark, pages.where("false"), 1000) == []


def test_members_end_in_zero_and_concatenate():
    records = [warc.record_bytes(i, "u", bytes([i]) * 300, "d", None, False) for i in range(5)]
    members = [warc.member(r) for r in records]
    assert all(m.endswith(b"\0") for m in members)
    assert gzip.open(io.BytesIO(b"".join(members))).read() == b"".join(records)


def test_false_magic_is_passed_over(tmp_path):
    inner = warc.member(warc.record_bytes(1, "u", b"inner", "d", None, False))
    outer = warc.record_bytes(2, "u", inner * 2 + b"tail", "d", None, False)
    stored = io.BytesIO()
    with gzip.GzipFile(fileobj=stored, mode="wb", compresslevel=0, mtime=0) as file:
        file.write(outer)  # stored blocks: the inner members' bytes lie open in the file
    data = stored.getvalue() + warc.member(warc.record_bytes(3, "u", b"x", "d", None, False))
    path = tmp_path / "a"
    path.write_bytes(data)
    for split in (64, 200, len(data)):
        got = [warc.parse_record(d)["fields"]["warc-record-id"] for s in range(0, len(data), split) for _, d in warc.members_in(str(path), s, min(len(data), s + split), len(data))]
        assert got == ["<urn:page:2>", "<urn:page:3>"]


class Counted(io.FileIO):
    read_bytes = 0

    def read(self, size=-1):
        got = super().read(size)
        Counted.read_bytes += len(got)
        return got


def test_each_byte_of_a_range_is_read_about_once(tmp_path, monkeypatch):
    """3,000 small records and some longer than a chunk; one range, and several."""
    records = [warc.record_bytes(i, "u", hashlib.sha256(b"%d" % i).digest() * (2000 if i % 500 == 0 else 40) + os.urandom(700), "d", None, False) for i in range(3000)]
    data = b"".join(map(warc.member, records))
    path = tmp_path / "a"
    path.write_bytes(data)
    monkeypatch.setattr(warc, "opened", lambda uri: Counted(uri))
    for split, most in ((len(data), 1.01), (-(-len(data) // 2), 1.6)):  # a range reads ahead by up to a mebibyte
        Counted.read_bytes, found = 0, []
        for start in range(0, len(data), split):
            found += [d for _, d in warc.members_in(str(path), start, min(len(data), start + split), len(data))]
        assert found == records
        assert Counted.read_bytes <= most * len(data), Counted.read_bytes / len(data)
