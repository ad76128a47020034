"""WARC archives: a writer, and a reader that splits compressed archives by byte range.

Every record is a gzip member of its own. A reading task has a byte range; it scans for the gzip magic, takes a
place as a member when its beginning decodes to a WARC header, owns the records that start inside its range and
reads the last of them to its end. Within a range members follow each other; that the first member of a range is
where the range before it ends is checked with a window over the ranges, and a range that was entered at a
look-alike (an archive stored inside a record) is read again from the right place.

Archives are written by the executors into the shared folder under names that no other attempt uses; only files
named by finished tasks are read, so a lost executor or a repeated task leaves nothing but an unused file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import attach, bitmap, cut, flagged, shared_dir

MAGIC = b"\x1f\x8b\x08"
RANGE = 4 << 20
FILE = 64 << 20
STEP = 256 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def _open(uri: str):
    """(filesystem, path) of a Hadoop-style path; file:/x and /x are local."""
    uri = re.sub(r"^file:/+", "/", uri)
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes | None, refers_to: int | None, date: str, digest: str | None = None, size: int | None = None, refers_url: str | None = None) -> bytes:
    """One compressed record; a revisit where refers_to is given, which carries the HTTP header but no payload.

    A revisit can do without the payload where its digest (hex) and size are given. Every record has an id of its own, also those of
    repeated or null page ids; a revisit names the response by URI, date and page.
    """
    if payload is not None:
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    link = lambda u, p: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", u or "") or f"urn:page:{p}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Target-URI: {link(url, page)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {link(refers_url, refers_to)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"X-Page-Id: {'' if page is None else page}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


WRITTEN = ("page_id", "url", "payload", "refers_to", "digest", "size", "refers_url")


def write_archives(rows: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", most: int = FILE) -> DataFrame:
    """Writes rows (columns of ``with_revisits``) and returns (path, bytes, records) of every archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        path, out, size, n = "", None, 0, 0
        done = []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page, url, payload, refers, *rest in zip(*[c.to_pylist() for c in batch.slice(at, 64).columns]):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        path, size, n = f"{folder}/{name}", 0, 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    data = record(page, url, payload, refers, date, *rest)
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= most:
                        out.close()
                        done.append((path, size, n))
                        out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "bytes", "records"])

    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    return cut(rows.select(*WRITTEN).mapInArrow(run, "path string, bytes long, records long"))


def _header_ok(data: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data, 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


class Forward:
    """A file read once, forwards from an offset: what was read beyond a member is the beginning of the next."""

    def __init__(self, f, at: int):
        f.seek(at)
        self.f, self.base, self.data, self.pos = f, at, b"", 0

    @property
    def offset(self) -> int:
        return self.base + self.pos

    def fill(self, need: int) -> int:
        """Has ``need`` bytes at hand, or all that are left; returns how many there are."""
        while len(self.data) - self.pos < need and (more := self.f.read(STEP)):
            self.data, self.base, self.pos = self.data[self.pos :] + more, self.base + self.pos, 0
        return len(self.data) - self.pos

    def find(self, end: int) -> int | None:
        """Goes to the first place before ``end`` where a member with a WARC header starts."""
        while self.offset < end and self.fill(len(MAGIC)) >= len(MAGIC):
            k = self.data.find(MAGIC, self.pos)
            self.pos = k if k >= 0 else len(self.data) - len(MAGIC) + 1
            if k >= 0 and self.offset < end:
                self.fill(4096)
                if _header_ok(self.data[self.pos : self.pos + 4096]):
                    return self.offset
                self.pos += 1
        return None

    def member(self) -> bytes:
        """The content of the member here; goes to the place after it."""
        un, out, at = zlib.decompressobj(31), [], self.offset
        while not un.eof:
            if not self.fill(1):
                raise EOFError(f"record at {at} is cut off")
            piece = self.data[self.pos : self.pos + (16 << 10)]
            out.append(un.decompress(piece))
            self.pos += len(piece) - len(un.unused_data)
        return b"".join(out)


def _parse(content: bytes) -> tuple:
    head, _, rest = content.partition(b"\r\n\r\n")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: int(field[k]) if field.get(k) else None
    digest = field["warc-payload-digest"].removeprefix("sha1:")
    if field["warc-type"] == "revisit":
        found = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", http)
        n = int(found[1]) if found else None
    else:
        n = len(payload)
        if base32_sha1(payload) != digest:
            raise ValueError(f"payload of {field.get('warc-record-id')} does not have its digest")
    return number("x-page-id"), n, digest, field["warc-type"], number("x-refers-to-page"), field.get("warc-target-uri")


def _read_ranges(ranges: DataFrame) -> DataFrame:
    """Records of the ranges (path, bytes, lo, hi, enter), and for each range one row with its first and next offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("lo", pa.int64()), ("first", pa.int64()), ("next", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())])
        for batch in batches:
            for path, size, lo, hi, enter in zip(*[c.to_pylist() for c in batch.columns]):
                fs, place = _open(path)
                rows = []
                with fs.open_input_file(place) as f:
                    source = Forward(f, lo if enter is None else enter)
                    first = last = source.find(hi) if enter is None else enter
                    while last is not None and last < hi:
                        rows.append((path, lo, None, None, *_parse(source.member())))
                        last = source.offset
                        if last < hi:
                            last = source.find(hi)
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                rows.append((path, lo, first, last, *[None] * 6))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return ranges.select("path", "bytes", "lo", "hi", "enter").mapInArrow(run, "path string, lo long, first long, next long, " + HEAD)


def read_archives(archives: DataFrame, range_bytes: int = RANGE, attempts: int = 20, most_tasks: int = 50_000) -> DataFrame:
    """All records of the archives (path, bytes): page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri."""
    lo = F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes))).alias("lo")
    ranges = archives.where("bytes > 0").select("path", "bytes", lo).withColumn("lo", F.col("lo").cast("long"))
    ranges = cut(ranges.select("path", "bytes", "lo", F.least(F.col("lo") + range_bytes, "bytes").alias("hi"), F.lit(None).cast("long").alias("enter")))
    # A stated number of partitions: rows this small would else be put together into one task.
    found = cut(_read_ranges(ranges.repartition(max(1, min(ranges.count(), most_tasks)), "path", "lo")))
    for _ in range(attempts):
        ends = found.where("next is not null or (page_id is null and payload_digest is null)").select("path", "lo", "first", "next").join(ranges.select("path", "lo", "hi"), ["path", "lo"])
        before = F.max("next").over(Window.partitionBy("path").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
        due = ends.withColumn("due", F.coalesce(before, F.lit(0))).withColumn("due", F.when(F.col("due") < F.col("hi"), F.col("due")))
        # Only the first range of a file that differs is sure to be entered wrongly.
        wrong = due.where(F.col("due").isNotNull() & ~F.col("due").eqNullSafe(F.col("first")) | F.col("due").isNull() & F.col("first").isNotNull())
        wrong = cut(wrong.groupBy("path").agg(F.min_by(F.struct("lo", "due", "hi"), "lo").alias("w")).select("path", "w.*"))
        if wrong.isEmpty():
            break
        again = wrong.join(archives.select("path", "bytes"), "path").select("path", "bytes", "lo", "hi", F.coalesce("due", "hi").alias("enter"))
        found = cut(found.join(wrong, ["path", "lo"], "left_anti").unionByName(_read_ranges(again)))
    else:
        raise RuntimeError("the archives' ranges do not join up")
    return found.where("payload_digest is not null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Rows to write (columns ``WRITTEN``): of equal payloads of at least ``least`` bytes all but the largest id refer to that.

    Pages that share no payload, by a bitmap of hashes, are not shuffled. The others are sent to their group without the payload, except
    those that stay a response, by a bitmap of groups with their largest ids. A null html is an empty payload. Rows repeated with
    the largest id are each written as response; a null id is smaller than any other, and pages whose ids are all null are responses.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("hash", F.when(F.col("size") >= least, F.xxhash64("payload")))
    shared = rows.where("hash IS NOT NULL").groupBy("hash").count().where("count > 1").select(F.col("hash").alias("_k"))
    marked = flagged(rows, "hash", bitmap(shared), "_shared").withColumn("_shared", F.col("_shared") & F.col("hash").isNotNull())
    alone = marked.where("NOT _shared").select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("digest"), "size", F.lit(None).cast("string").alias("refers_url"))
    some = marked.where("_shared").withColumn("digest", F.sha1("payload")).withColumn("key", F.concat("digest", F.col("size").cast("string")))
    first = F.max(F.struct("page_id", "url"))
    groups = cut(some.groupBy("key").agg(first.alias("first"), F.count("*").alias("count")).select("key", "count", F.col("first.page_id").alias("keep"), F.col("first.url").alias("refers_url")))
    winners = bitmap(groups.select(F.xxhash64("key", "keep").alias("_k")))
    some = flagged(some.withColumn("_own", F.xxhash64("key", "page_id")), "_own", winners, "_response")
    thin = some.select("page_id", "url", F.when(F.col("_response"), F.col("payload")).alias("payload"), "digest", "size", "key")
    total = groups.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    out = attach(thin, groups, "key", "count", "page_id", total).withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")))
    return alone.unionByName(out.select(*WRITTEN))


def round_trip(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes the pages as archives (into a new folder of the shared one, if none is given) and reads these back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri. A null html is an empty payload; repeated rows
    are each written; a null id stays null; very long pages are one record each. Other columns are ignored; an empty table gives an empty result.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(with_revisits(pages, **columns), folder))
