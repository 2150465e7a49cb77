"""Legacy web archives: ARC files read by version and declared length, and turned into WARC.

Archives are plain files in a shared folder, one gzip member a record and one for its end, cut
at FILE_BYTES: a task packs the members of one file into one value, and Spark's text writer puts
each value into a file of its own, with the end of its last record as the separator of
lines.  They are read with Spark's binaryFile source, a file a row, opened member by member
as they are read, and cut into records by the lengths they declare, never by searching: a line
that should be a header and is none ends the reading of its file with an error or, if asked
for, with a row that says so.  So a task holds one file as it is packed, and one record opened.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, saved, scratch, table

#: Fields of a record's header line by version of the format, as its version block names them (fixed values).
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Header lines by version: url, type and location may hold spaces, so the address and date, the result after the type, and the last fields tell them apart.
HEADERS = {
    1: re.compile(rb"(?P<url>.+) (?P<ip>[0-9A-Fa-f.:]+|-) (?P<date>\d{8,17}) (?P<mime>.*) (?P<length>\d+)"),
    2: re.compile(rb"(?P<url>.+) (?P<ip>[0-9A-Fa-f.:]+|-) (?P<date>\d{8,17}) (?P<mime>.*?) (?P<result>\d{1,3}|-) \S+ .+ (?:\d+|-) \S+ (?P<length>\d+)"),
}
CRLF = b"\r\n"
#: Names the record identifiers that are made from a record's own content.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-to-warc")
PAGE = re.compile(rb"(?im)^X-Page-Id:[ \t]*(-?\d+)\r?$")
LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*(\d+)\r?$")
#: Bytes of an archive that is written here (one record at least), and of payloads in an Arrow batch.
FILE_BYTES, BATCH_BYTES = 32_000_000, 4_000_000
#: Bytes that are opened at a time.
STEP = 65536
#: Revisits (some 250 bytes each) up to which what is decided is broadcast; more are shuffled with the archives.
BROADCAST_REVISITS = 200_000
SLIM = [("path", pa.string()), ("place", pa.int32()), ("record_id", pa.string()), ("version", pa.int32()), ("kind", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("date_exact", pa.bool_()), ("mime", pa.string()), ("result", pa.int32()),
        ("declared", pa.int64()), ("truncated", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("page_id", pa.int64())]
BODIES = [("http", pa.binary()), ("payload", pa.binary())]
SPARK_TYPES = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}


def ddl(fields: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{name} {SPARK_TYPES[kind]}" for name, kind in fields)


def digest(data: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """A gzip member without a time, so that reruns write the same bytes."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Opened:
    """The bytes of an archive, its gzip members (if it has any) opened one after the other as they are read."""

    def __init__(self, content: bytes) -> None:
        self.packed = content[:2] == b"\x1f\x8b"
        self.view, self.at, self.z = memoryview(content), 0, None
        self.held, self.start = bytearray(), 0

    def more(self) -> bool:
        """Open some more bytes; false at the end.  A file that ends inside a member gives what is there."""
        del self.held[: self.start]
        self.start = 0
        while self.at < len(self.view):
            step = self.view[self.at : self.at + STEP]
            if not self.packed:
                new, self.at = step, self.at + len(step)
            else:
                self.z = self.z or zlib.decompressobj(31)
                new = self.z.decompress(step)
                self.at += len(step) - len(self.z.unused_data)
                if self.z.eof:
                    self.z = None
            self.held += new
            if len(new):
                return True
        return False

    def line(self) -> bytes:
        """Up to the next line feed, with it; empty at the end."""
        seen = self.start
        while (end := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held) - self.start
            if not self.more():
                end = len(self.held) - 1
                break
        out, self.start = bytes(self.held[self.start : end + 1]), end + 1
        return out

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        while len(self.held) - self.start < n and self.more():
            pass
        out = bytes(self.held[self.start : self.start + n])
        self.start += len(out)
        return out


def iso_date(stamp: str) -> tuple[str, bool]:
    """YYYYMMDD[hh[mm[ss[fraction]]]] as an ISO 8601 instant, to seconds, and whether all of it could be read.

    What follows a part that is cut short or cannot be (month 13, 30 February) is left out.
    """
    parts, whole = [1970, 1, 1, 0, 0, 0], len(stamp) in (8, 10, 12, 14, 15, 16, 17)
    for k, (lo, hi) in enumerate(((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14))):
        if len(stamp) < hi:
            break
        tried = [*parts[:k], int(stamp[lo:hi]), *([1970, 1, 1, 0, 0, 0][k + 1 :])]
        try:
            datetime(*tried)
        except ValueError:
            whole = False
            break
        parts = tried
    return "{:04}-{:02}-{:02}T{:02}:{:02}:{:02}Z".format(*parts), whole


class Damaged(ValueError):
    """A line that should be a record's header and is none."""


def parse_header(line: bytes, version: int | None) -> tuple[int, dict[str, str]]:
    """Version and fields of a header line; without a version block the longer form is tried first."""
    for v in (version,) if version in HEADERS else (2, 1):
        if m := HEADERS[v].fullmatch(line.rstrip(b"\r\n")):
            return v, {k: x.decode("utf-8", "replace") for k, x in m.groupdict().items()}
    raise Damaged(f"no header of version {version or '1 or 2'}: {line[:200]!r}")


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (up to and with the empty line) and body; a block without a head is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    for end in (b"\r\n\r\n", b"\n\n"):
        if (k := block.find(end)) >= 0:
            return block[: k + len(end)], block[k + len(end) :]
    return block, b""


def arc_records(data: Opened) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Version, header fields and block of the records of one archive.

    The version is what the archive's version block (its filedesc record) says.  Blocks are
    taken by their declared length, so they may hold anything; one that ends early is
    given as it is.  Between records only line ends may stand; anything else that is no header raises Damaged.
    """
    version = None
    while line := data.line():
        if not line.strip(b"\r\n"):
            continue
        said = re.match(rb"filedesc:\S* .* (\d+)\r?\n?$", line)
        block = data.take(int(said[1])) if said else None
        if said:  # the version block itself says how all headers are laid out
            first = block.split(b"\n", 1)[0].split()
            if first and first[0].isdigit():
                version = int(first[0])
        own, h = parse_header(line, version)
        yield own, h, data.take(int(h["length"])) if block is None else block


def converted(path: str, data: Opened, bodies: bool, damage: str) -> Iterator[dict]:
    """Rows of read_arc() for one archive."""
    place = -1
    try:
        for place, (version, h, block) in enumerate(arc_records(data)):
            kind = "warcinfo" if h["url"].startswith("filedesc:") else "response" if block.startswith(b"HTTP/") else "resource"
            http, payload = split_http(block) if kind == "response" else (b"", block)
            page, status, own = PAGE.search(http), re.match(rb"HTTP/\S+ +(\d{3})", http), digest(payload)
            date, exact = iso_date(h["date"])
            row = {
                "path": path, "place": place, "record_id": f"<urn:uuid:{uuid.uuid5(SPACE, ' '.join((h['url'], h['date'], own, digest(http))))}>", "version": version, "kind": kind, "url": h["url"], "ip": h["ip"], "date": date, "date_exact": exact, "mime": h["mime"],
                "result": int(h["result"]) if h.get("result", "").isdigit() else int(status[1]) if status else None, "declared": int(h["length"]), "truncated": len(block) < int(h["length"]),
                "payload_bytes": len(payload), "payload_digest": own, "page_id": int(page[1]) if page else None,
            }
            yield row | ({"http": http, "payload": payload} if bodies else {})
    except Damaged as e:
        if damage == "raise":
            raise Damaged(f"{path}, after {place + 1} records: {e}") from e
        yield {"path": path, "place": place + 1, "kind": "damaged", "truncated": True}


def batched(rows: Iterator[dict], fields: list[tuple[str, pa.DataType]], body: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some BATCH_BYTES, a row at least."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.get(body) or b"") + 500
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, pa.schema(fields))
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, pa.schema(fields))


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the files that Spark's writers have left below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, bodies: bool = True, damage: str = "raise") -> DataFrame:
    """Every record of the ARC files below ``path`` with what its WARC twin needs.

    Payloads are bytes of any encoding.  ``damage``: "raise" fails on a file whose records
    cannot be told apart any more, "report" ends it with a row of kind damaged.  A date that cannot be
    read in full keeps what can be, and date_exact is false.  Archives of 2 GB or more as they are
    packed, which one row cannot hold, fail; those that are written here are cut long before.
    """
    fields = SLIM + (BODIES if bodies else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, content in zip(b.column(0), b.column(1)):
                yield from batched(converted(where.as_py(), Opened(content.as_buffer()), bodies, damage), fields, "payload")

    return archives(spark, path).mapInArrow(run, ddl(fields))


def decide(records: DataFrame) -> DataFrame:
    """path, place, payload_digest, refers_id, refers_url, refers_date of every record; refers_* are null but for revisits.

    Of equal payloads the record with the largest page_id stays a response, and so do
    records of the same identifier (repeated rows).  One slim aggregate finds it for each digest that
    occurs twice or more; as a written table it is joined by digest, a join whose large
    groups Spark can split.
    """
    slim = records.select("path", "place", "kind", "payload_digest", F.struct(F.coalesce("page_id", F.lit(-(2**62))).alias("p"), "record_id", "url", "date").alias("r"))
    best = cut(slim.where("kind = 'response'").groupBy("payload_digest").agg(F.max("r").alias("best"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "best"))
    revisit = (F.col("kind") == "response") & (F.col("best.record_id") != F.col("r.record_id"))
    return slim.join(best, "payload_digest", "left").select("path", "place", "payload_digest", *[F.when(revisit, F.col(f"best.{c}")).alias(f"refers_{n}") for c, n in (("record_id", "id"), ("url", "url"), ("date", "date"))])


def warc_record(r: dict, refers: dict) -> bytes:
    """A WARC record but its end; of a revisit the block is the head alone, so its digest is left out."""
    revisit, page = refers["refers_id"] is not None, r["kind"] != "warcinfo"
    block = r["http"] if revisit else r["http"] + r["payload"]
    fields = [
        ("WARC-Type", "revisit" if revisit else r["kind"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"] if page else None), ("WARC-IP-Address", r["ip"] if page else None),
        ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}" if page else None), ("WARC-Block-Digest", None if revisit else f"sha1:{digest(block)}"),
        ("WARC-Refers-To", refers["refers_id"]), ("WARC-Refers-To-Target-URI", refers["refers_url"]), ("WARC-Refers-To-Date", refers["refers_date"]),
        ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" if revisit else None), ("WARC-Truncated", "length" if r["truncated"] else None),
        ("Content-Type", "application/http; msgtype=response" if r["http"] else r["mime"] if page else "application/warc-fields"), ("Content-Length", len(block)),
    ]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + CRLF + block


def files(records: Iterator[bytes], end: bytes, file_bytes: int, head: bytes | None = None) -> Iterator[pa.RecordBatch]:
    """Records as gzip members, packed into one value for each file of ``file_bytes`` or a record; ``head`` starts each."""
    held, size, between = [], 0, member(end)

    def value() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([between.join(([head] if head else []) + held)], pa.binary())], ["value"])

    for r in records:
        packed = member(r)
        if held and size + len(packed) > file_bytes:
            yield value()
            held, size = [], 0
        held.append(packed)
        size += len(packed) + len(between)
    if held:
        yield value()


def write_archives(values: DataFrame, target: str, end: bytes) -> None:
    """A file for each value of files(), and the end of its last record."""
    text = values.select(F.col("value").cast("string").alias("value"))  # the bytes stay as they are
    text.write.option("encoding", "ISO-8859-1").option("lineSep", member(end).decode("latin-1")).option("maxRecordsPerFile", 1).text(target)


def arc_to_warc(spark: SparkSession, source: str, target: str, damage: str = "raise", file_bytes: int = FILE_BYTES) -> None:
    """Convert the ARC archives below ``source`` into WARC archives of about ``file_bytes`` below ``target``.

    A first pass reads heads and digests only and decides; which records become revisits meets
    each archive by its path, so no payload leaves its archive before it is written.
    """
    slim, path = saved(read_arc(spark, source, bodies=False, damage=damage).where("kind <> 'damaged'"), "heads")
    decided = cut(decide(slim).where("refers_id is not null").groupBy("path").agg(F.collect_list(F.struct("place", "refers_id", "refers_url", "refers_date")).alias("refers")))
    few = decided.agg(F.coalesce(F.sum(F.size("refers")), F.lit(0))).first()[0] <= BROADCAST_REVISITS

    none = dict.fromkeys(("refers_id", "refers_url", "refers_date"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                for where, content, refers in zip(b.column(0), b.column(1), b.column(2)):
                    known = {x["place"]: x for x in refers.as_py() or ()}
                    for r in converted(where.as_py(), Opened(content.as_buffer()), True, "report"):
                        if r["kind"] != "damaged":
                            yield warc_record(r, known.get(r["place"], none))

        yield from files(records(), CRLF * 2, file_bytes)

    write_archives(archives(spark, source).join(F.broadcast(decided) if few else decided, "path", "left").select("path", "content", "refers").mapInArrow(run, "value binary"), target, CRLF * 2)
    discard(spark, path)


def warc_records(data: Opened) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record, by declared lengths."""
    while line := data.line():
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/"):
            raise Damaged(f"no WARC header: {line[:200]!r}")
        lines = []
        while (own := data.line()) not in (CRLF, b""):
            lines.append(own.decode("utf-8", "replace").rstrip("\r\n"))
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        yield fields, data.take(int(fields.get("content-length", 0)))


WARC_FIELDS = [("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_id", pa.string())]


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Responses, resources and revisits of the WARC files below ``path``, with their payloads if asked for.

    The digest of a payload that is there is computed anew and must equal the declared
    one; a revisit tells the size of the full payload by the Content-Length of its HTTP head.
    """
    fields = WARC_FIELDS + ([("payload", pa.binary())] if payloads else [])

    def rows(data: Opened) -> Iterator[dict]:
        for h, block in warc_records(data):
            kind = h["warc-type"]
            if kind not in ("response", "resource", "revisit"):
                continue
            http, payload = split_http(block) if "application/http" in h.get("content-type", "") else (b"", block)
            said = h.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind != "revisit" and said != digest(payload):
                raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
            page, length = PAGE.search(http), LENGTH.search(http)
            row = {
                "record_id": h["warc-record-id"], "record_type": kind, "url": h.get("warc-target-uri"), "date": h.get("warc-date"), "page_id": int(page[1]) if page else None,
                "payload_bytes": len(payload) if kind != "revisit" else int(length[1]) if length else None, "payload_digest": said, "refers_id": h.get("warc-refers-to"),
            }
            yield row | ({"payload": payload if kind != "revisit" else None} if payloads else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(1):
                yield from batched(rows(Opened(content.as_buffer())), fields, "payload")

    return archives(spark, path).mapInArrow(run, ddl(fields))


def write_arc(pages: DataFrame, target: str, stamp: str = "20200101000000", file_bytes: int = FILE_BYTES) -> None:
    """ARC archives of pages (page_id, url, html), versions 1 and 2 by task in turn.

    The html in UTF-8 is the body of an HTTP response that also carries the page_id; null
    html is an empty body.  White space in a url is percent-encoded; a page without url
    gets one made from its id.  Each file starts with a version block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        title = f"{version} 0 coupling-archive\n{TITLES[version]}\n"
        ends = {1: "", 2: f"200 - - 0 part-{part:05d}.arc "}[version]
        block = member(f"filedesc://part-{part:05d}.arc 0.0.0.0 {stamp} text/plain {ends}{len(title)}\n{title}".encode())

        def records() -> Iterator[bytes]:
            for b in batches:
                for page, url, html in zip(*(b.column(i) for i in range(3))):
                    page, url, body = page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass")
                    mark = "" if page is None else f"X-Page-Id: {page}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(body)}\r\n\r\n".encode()
                    where = re.sub(r"\s", lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), url or "") or f"urn:page:{page}"
                    yield f"{where} 0.0.0.0 {stamp} text/html {ends}{len(head) + len(body)}\n".encode() + head + body

        yield from files(records(), b"\n", file_bytes, block)

    # the cast to long keeps the layout of the batches fixed whatever the table's types are
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    write_archives(rows.mapInArrow(run, "value binary"), target, b"\n")


def query(spark, sf_dir: str) -> DataFrame:
    """A WARC record for each page, read back.  Null html is an empty payload, a null page_id or url one of its own.  Rows of one page_id and url that repeat share a record and its decision."""
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    arc_to_warc(spark, arc, warc)
    back = cut(read_warc(spark, warc, payloads=False))
    discard(spark, arc, warc)
    # records alike in url, date, head and payload share an identifier, and so one decision
    target = cut(back.where(F.col("record_type") == "response").join(back.where("refers_id is not null").select(F.col("refers_id").alias("record_id")).distinct(), "record_id", "left_semi").groupBy(F.col("record_id").alias("of")).agg(F.max("page_id").alias("refers_to")))
    return back.join(target, F.col("refers_id") == F.col("of"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p),
g AS (SELECT *, [CAST('0x' || hex[1 + 5 * k : 5 + 5 * k] AS BIGINT) for k in range(8)] AS v FROM d)
SELECT page_id, payload_bytes,
       array_to_string([array_to_string([('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[1 + ((x >> (15 - 5 * j)) & 31)] for j in range(4)], '') for x in v], '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM g
"""
