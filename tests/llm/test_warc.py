import base64
import gzip
import hashlib

import pytest

from tandem.llm import warc
from tandem.llm.common import scratch


def b32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def round_trip(spark, pages):
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(pages, arc)
    warc.arc_to_warc(spark, arc, out)
    return out, warc.read_warc(spark, out).collect()


@pytest.mark.parametrize("few", [200_000, 0])
def test_round_trip(spark, few, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", few)
    body = "WARC/1.0\r\n\r\nhttp://x 1 2 3 4\nContent-Length: 5\r\n\r\nü"
    rows = [(1, "http://a/", body), (2, "http://b/x y", body), (3, None, None), (4, "", ""), (5, "http://c/", "z" * 300_000), (None, "http://n/", "only"), (9, "http://a/", body)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    _, got = round_trip(spark, pages)
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(raw), b32(raw))
        if by[i].record_type == "response":
            assert bytes(by[i].payload) == raw
    assert {i: r.record_type for i, r in by.items()} == {1: "revisit", 2: "revisit", 3: "revisit", 4: "response", 5: "response", None: "response", 9: "response"}
    assert by[1].refers_id == by[2].refers_id == by[9].record_id and by[3].refers_id == by[4].record_id
    assert by[2].url == "http://b/x%20y"


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert round_trip(spark, pages)[1] == []


def converted(data):
    return list(warc.converted("x", warc.Opened(data), True, "raise"))


def test_both_versions_are_parsed():
    v1 = b"filedesc://a 0.0.0.0 20000101 text/plain 4\n1 0\n\nhttp://a/ 1.2.3.4 20010203040506 text/html 7\nHTTP/1.\n"
    v2 = b"http://b/ 1.2.3.4 200102030405 text/html 404 - - 0 f.arc 26\nHTTP/1.0 404 No\r\n\r\nbody\n12\n"
    said = b"filedesc://b 0.0.0.0 20000101 text/plain 200 - - 0 f.arc 4\n2 0\n\n"
    a = converted(v1 + said + v2)
    assert [(r["kind"], r["version"], r["date"]) for r in a] == [("warcinfo", 1, "2000-01-01T00:00:00Z"), ("response", 1, "2001-02-03T04:05:06Z"), ("warcinfo", 2, "2000-01-01T00:00:00Z"), ("response", 2, "2001-02-03T04:05:00Z")]
    assert a[3]["payload"] == b"body\n12" and a[3]["result"] == 404 and a[3]["mime"] == "text/html" and not a[3]["truncated"]
    assert converted(gzip.compress(v1) + gzip.compress(said) + gzip.compress(v2))[3]["payload"] == b"body\n12"
    # without a version block the longer form goes first
    assert converted(v2)[0]["version"] == 2


def test_short_body_is_marked():
    (r,) = converted(b"http://a/ 1.2.3.4 20010203040506 text/html 70\nHTTP/1.1 200 OK\r\n\r\nshort")
    assert r["truncated"] and r["payload"] == b"short" and r["declared"] == 70
    assert converted(b"") == []
    with pytest.raises(warc.Damaged):
        converted(b"a b c d x\n")


def test_wrong_digest_is_refused(spark, tmp_path):
    rec = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "part-0.txt").write_bytes(rec)
    with pytest.raises(Exception, match="does not match"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_headers_with_spaces_and_bytes_of_any_encoding(spark, tmp_path):
    body = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\nhttp://evil/ 1.2.3.4 20200101000000 text/html 4\nfake\xff\xfe\x00"
    title = f"1 0 origin\n{warc.TITLES[1]}\n".encode()
    data = b"filedesc://x.arc 0.0.0.0 20200101000000 text/plain %d\n%s\n" % (len(title), title)
    data += b"http://a/b c 10.0.0.1 20200102030405 text/html; charset=utf-8 %d\n%s\n" % (len(body), body)
    data += b"\nhttp://d/ 10.0.0.1 20200102 - 3\nxyz\n"
    for name, content in (("part-plain", data), ("part-packed", gzip.compress(data))):
        (tmp_path / name).write_bytes(content)
    got = warc.read_arc(spark, str(tmp_path)).where("kind <> 'warcinfo'").collect()
    assert sorted((r.url, r.mime, r.version, r.kind, bytes(r.payload)) for r in got) == sorted(2 * [("http://a/b c", "text/html; charset=utf-8", 1, "response", body.split(b"\r\n\r\n")[1]), ("http://d/", "-", 1, "resource", b"xyz")])
    out = str(tmp_path / "warc")
    warc.arc_to_warc(spark, str(tmp_path), out)
    assert {bytes(r.payload) for r in warc.read_warc(spark, out).collect() if r.payload is not None} == {body.split(b"\r\n\r\n")[1], b"xyz"}


def test_a_bad_header_never_makes_a_record(spark, tmp_path):
    bad = b"http://a/ 1.1.1.1 20200101000000 text/html 5\nhello\nnot a header\nhttp://evil/ 1.2.3.4 20200101000000 text/html 4\nfake\n"
    (tmp_path / "part-0").write_bytes(bad)
    got = warc.read_arc(spark, str(tmp_path), damage="report").collect()
    assert [(r.kind, r.url) for r in got] == [("resource", "http://a/"), ("damaged", None)]
    with pytest.raises(Exception, match="no header"):
        warc.read_arc(spark, str(tmp_path)).collect()


def test_one_gzip_member_a_record(spark):
    import zlib

    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i}") for i in range(5)], "page_id long, url string, html string").coalesce(1)
    arc = scratch(spark, "arc")
    warc.write_arc(pages, arc)
    (content,) = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(arc).collect() if r.content]
    parts = []
    while content:
        z = zlib.decompressobj(31)
        parts.append(z.decompress(content))
        content = z.unused_data
    assert len(parts) == 12 and parts[1::2] == [b"\n"] * 6 and parts[2].startswith(b"http://a/0 ")


def test_repeated_pages_share_a_decision(spark):
    pages = spark.createDataFrame([(7, "http://a/", "x"), (7, "http://a/", "x"), (3, "http://b/", "x")], "page_id long, url string, html string")
    _, got = round_trip(spark, pages)
    assert sorted((r.page_id, r.record_type) for r in got) == [(3, "revisit"), (7, "response"), (7, "response")]


def contents(spark, path):
    return [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect() if r.content]


def test_files_hold_a_bounded_number_of_bytes(spark):
    import random

    rng = random.Random(0)
    pages = spark.createDataFrame([(i, f"http://a/{i}", rng.randbytes(900 if i != 5 else 9000).hex() if i % 3 else "same") for i in range(40)], "page_id long, url string, html string").coalesce(1)
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(pages, arc, file_bytes=4000)
    warc.arc_to_warc(spark, arc, out, file_bytes=3000)
    for path, limit in ((arc, 4000), (out, 3000)):
        sizes = sorted(map(len, contents(spark, path)))
        assert len(sizes) > 8 and sizes[-2] < limit + 300 and sizes[-1] > 9000  # one record alone is longer
    assert all(gzip.decompress(c).startswith(b"filedesc://") for c in contents(spark, arc))
    got = warc.read_warc(spark, out).collect()
    assert sorted(r.page_id for r in got) == list(range(40)) and sum(r.record_type == "revisit" for r in got) == 13


@pytest.mark.parametrize("step", [1, 7, 65536])
def test_archives_are_opened_as_they_are_read(step, monkeypatch):
    monkeypatch.setattr(warc, "STEP", step)
    lines = [b"one\n", b"", b"x" * 300 + b"\n", b"\r\n", b"last"]
    raw = b"".join(lines)
    for data in (raw, gzip.compress(raw), b"".join(map(gzip.compress, lines))):
        o = warc.Opened(data)
        assert [o.line() for _ in range(5)] == [b"one\n", b"x" * 300 + b"\n", b"\r\n", b"last", b""]
        o = warc.Opened(data)
        assert o.take(2) + o.line() == b"one\n" and o.take(301) == b"x" * 300 + b"\n" and o.take(99) == b"\r\nlast" and o.take(1) == o.line() == b""
    assert warc.Opened(b"").line() == b"" and len(warc.Opened(gzip.compress(raw)[:-12]).take(999)) <= len(raw)


@pytest.mark.parametrize("stamp, want", [
    ("20010203", ("2001-02-03T00:00:00Z", True)), ("2001020304", ("2001-02-03T04:00:00Z", True)), ("200102030405", ("2001-02-03T04:05:00Z", True)),
    ("20010203040506", ("2001-02-03T04:05:06Z", True)), ("20010203040506789", ("2001-02-03T04:05:06Z", True)), ("20019999999999", ("2001-01-01T00:00:00Z", False)),
    ("20010230040506", ("2001-02-01T00:00:00Z", False)), ("20010203250000", ("2001-02-03T00:00:00Z", False)), ("200102030", ("2001-02-03T00:00:00Z", False)), ("00000101", ("1970-01-01T00:00:00Z", False)),
])
def test_dates_keep_what_can_be_read(stamp, want):
    assert warc.iso_date(stamp) == want
    (r,) = converted(f"http://a/ 1.2.3.4 {stamp} text/html 2\nhi".encode())
    assert (r["date"], r["date_exact"]) == want


def test_a_location_with_spaces():
    (r,) = converted(b"http://a/b c 1.2.3.4 20010203040506 text/html; charset=utf-8 302 ABC http://x/a b 12 9 f.arc 2\nhi")
    assert (r["url"], r["mime"], r["result"], r["version"], r["payload"]) == ("http://a/b c", "text/html; charset=utf-8", 302, 2, b"hi")
    (r,) = converted(b"http://a/ - 20010203040506 - - - - - f.arc 2\nhi")
    assert (r["mime"], r["result"], r["ip"], r["version"]) == ("-", None, "-", 2)
