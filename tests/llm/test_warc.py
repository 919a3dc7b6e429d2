import hashlib
import os
import zlib

import pytest

from attesta.llm.common import Workspace
from attesta.llm.warc import chunked, page_records, parse_records, read_archives, unchunked, write_archives

SCHEMA = "page_id long, url string, html string, digest string, body string, original long"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 1) for i, u, h in rows], SCHEMA)


def trip(spark, rows):
    ws = Workspace(spark, "test")
    return ws, read_archives(spark, write_archives(frame(spark, rows), ws))


def test_round_trip(spark):
    big, same = "é" * 40_000 + "\r\n0\r\n\r\nend", "<p>same</p>" * 20
    rows = [(1, "http://a/\r\nX-Bad: 1", big), (7, "u", same), (5, None, same), (9, "u", same), (2, "u", None), (3, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", "none" * 50), (8, "u", "x" * 100), (10, "u", "x" * 100), (11, "u", "x" * 99), (12, "u", "x" * 99), (13, "u", big)]
    _, back = trip(spark, rows)
    got = {r.page_id: r for r in back.collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        body, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.digest) == (len(body), hashlib.sha256(body).hexdigest())
        if r.record_type == "response":
            assert bytes(r.payload) == body and r.refers_to is None
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {7: 5, 9: 5, 10: 8, 13: 1}


def test_repeated_rows_stay(spark):
    _, back = trip(spark, [(1, "u", "z" * 90_000), (1, "u", "z" * 90_000), (1, "u", "other")])
    assert sorted(r.payload_bytes for r in back.collect()) == [5, 90_000, 90_000]


def test_repeated_ids_in_many_tasks(spark):
    """Rows of one id with different payloads, each in a task of its own, are records of their own; ids below zero and revisits among them hold."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i % 3 - 1, "u", chr(65 + i) * 90_000) for i in range(9)] + [(5, "u", "A" * 90_000), (5, "u", "A" * 90_000)]
        _, back = trip(spark, rows)
        got = back.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted((i, hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows)
    assert sorted((r.page_id, r.digest) for r in got) == want and len({r.record_id for r in got}) == len(rows)
    assert [r.refers_to for r in got if r.page_id == 5] == [-1, -1] and {r.record_type for r in got if r.page_id != 5} == {"response"}


def test_stale_files_are_not_read(spark):
    """What a task left that ran again is not in the manifest."""
    ws = Workspace(spark, "test")
    address = write_archives(frame(spark, [(1, "u", "abc")]), ws)
    folder = address.removeprefix("file://")
    have = [f for f in os.listdir(folder) if f.endswith(".gz")]
    with open(f"{folder}/{have[0]}", "rb") as a, open(f"{folder}/part-000000-999-0000.warc.gz", "wb") as b:
        b.write(a.read())
    assert read_archives(spark, address).count() == 1 and read_archives(spark, address, payload=False).first().payload is None


def test_streams_are_read_as_they_come():
    """Records larger than a window, plain, member by member and as one member, with a short last one."""
    records = [r for k in range(5) for r in page_records(f"urn:page:{k}", k, "u", bytes([65 + k]) * (50_000 * k), "", None, segment=1 << 30)]
    pack = lambda x: (lambda c: c.compress(x) + c.flush())(zlib.compressobj(1, zlib.DEFLATED, 31))
    for data in (b"".join(records), b"".join(map(pack, records)), pack(b"".join(records))):
        assert [int(h["x-page-id"]) for h, _ in parse_records(data)] == [0, 1, 2, 3, 4]
        with pytest.raises(ValueError):
            list(parse_records(data[:-30]))


def test_empty_table(spark):
    ws = Workspace(spark, "test")
    address = write_archives(frame(spark, []), ws)
    assert read_archives(spark, address).count() == 0


def test_missing_and_damaged_segments(spark):
    body = os.urandom(50_000)
    records = page_records("urn:page:1", 1, "u", body, hashlib.sha256(body).hexdigest(), None, segment=4096)
    assert len(records) > 10
    for k, bad in enumerate((records[:-1], records[:3] + records[4:], records[1:], [records[0][:-2000], *records[1:]])):
        ws = Workspace(spark, "test")
        folder = f"{ws.path}/warc".removeprefix("file://")
        os.makedirs(folder)
        with open(folder + "/part.warc.gz", "wb") as f:
            for r in bad:
                c = zlib.compressobj(1, zlib.DEFLATED, 31)
                f.write(c.compress(r) + c.flush())
        with pytest.raises(Exception, match="segments|cut short|ValueError"):  # noqa: PT011
            read_archives(spark, f"{ws.path}/warc").collect()
        assert k < 4


def test_framing():
    for body in (b"", b"a", b"x" * 20_000, b"\r\n0\r\n\r\n"):
        assert unchunked(chunked(body, 7)) == body
    assert unchunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    plain = b"".join(page_records("urn:page:1", 1, "u", b"abc", "d", None))
    assert [h["warc-type"] for h, _ in parse_records(plain)] == ["response"]
    with pytest.raises(ValueError):
        list(parse_records(plain[:-6]))
