"""WARC archives with a two-level capture index.

Writing: each task writes its pages as gzip members, one per record, into archives of bounded size in the
shared folder. Of records with equal payloads one is the response, the others are revisit records that
refer to it. Each record's capture line - reversed-host URL key, time, page id, record type, digest, archive,
offset, length - goes into the index.

Index: capture lines are range-partitioned and sorted by URL key, page id and row number, cut into blocks of
``LINES_PER_BLOCK`` lines, each compressed by itself; a sparse directory keeps the first and last key, file, offset
and length of each block. A lookup does a binary search in the directory, reads one block (or the run of blocks
that a URL key spans) by range, searches the lines, and reads just the records' ranges of the archives. The
directory itself is cut into parts of ``DIRECTORY_LINES`` lines behind one top line each, so a lookup reads one
part of it.

Reading back: every page is looked up by its key. The pages are sorted like the index and dealt in ranges to the
tasks, so a task reads each of its blocks once, and the id in the key cuts a URL with very many captures up.

Defined results: null html is an empty payload, null url an empty key; equal payloads among rows with the
same page id are told apart by their position; a page with a null id may refer but is never referred to
unless all ids of its payload are null; an empty table gives an empty archive set and index.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sharedfs
from .common import fresh_path, shuffle_partitions, staged

ARCHIVE_BYTES = 32 << 20
LINES_PER_BLOCK = 1000
DIRECTORY_LINES = 10_000
#: Smallest payload that is worth a revisit record.
REVISIT_FROM = 0
#: Equal payloads of more pages than this are joined by broadcast: there are at most rows / HOT_ROWS such payloads.
HOT_ROWS = 100_000
#: Records that are read at once, and the largest gap and range of one read.
FETCH_RECORDS, FETCH_GAP, FETCH_BYTES = 512, 1 << 15, 4 << 20
_EPOCH = "2024-01-01T00:00:00Z"
_LEVEL = 6


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``com,example,www)/a?b``; scheme, port 80/443, user and fragment go."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return re.sub(r"\s", "%20", (url or "").lower())
    host = re.sub(r"^www\d*\.", "", host)
    at = ",".join(reversed(host.split("."))) if host else ""
    if port and port not in (80, 443):
        at += f":{port}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", f"{at}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, seq) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{seq}>"


def record(page_id, seq, url: str, payload: bytes, digest: str, refers_to, refers_seq) -> bytes:
    """One WARC 1.1 record, uncompressed: a response, or a revisit if it refers to another record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_seq is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, seq)}", f"WARC-Date: {_EPOCH}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url or ""), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Page-Seq: {seq}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, refers_seq)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers of an uncompressed record, with its ``payload`` (None for a revisit); checks lengths and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    found: dict = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(found["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record has another length than its header says")
    _, _, payload = rest[:n].partition(b"\r\n\r\n")
    found["payload"] = payload if found["WARC-Type"] == "response" else None
    if found["payload"] is not None and f"sha1:{digest_of(payload)}" != found["WARC-Payload-Digest"]:
        raise ValueError("a payload does not have its digest")
    return found


def _members(data: bytes):
    """(offset, length, record) of each gzip member."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        out = z.decompress(data[at:] if len(data) - at < 1 << 16 else data[at : at + (1 << 16)])
        n = min(len(data) - at, 1 << 16) - len(z.unused_data)
        while not z.eof:
            chunk = data[at + n : at + n + (1 << 18)]
            if not chunk:
                raise ValueError("an archive ends within a record")
            out += z.decompress(chunk)
            n += len(chunk) - len(z.unused_data)
        yield at, n, out
        at += n


_CAPTURE = "page_id long, seq long, url_key string, record_type string, digest string, refers_to long, archive string, offset long, length long"


def numbered_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, payload, sha1, n, seq`` in a written copy, for row numbers hold for one reading of a table only."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    return staged(rows.withColumn("seq", F.monotonically_increasing_id()), "warc-in")


def responses_of(rows: DataFrame, revisit_from: int) -> DataFrame:
    """``seq, keep_seq, keep_id`` of the rows that revisit another row's payload."""
    one = rows.where(F.col("n") >= revisit_from).select("sha1", "n", F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("id"), (-F.col("seq")).alias("seq")).alias("best"))
    # Classes first without the payloads; the partial maximum takes the weight off a payload that many pages share.
    classes = one.groupBy("sha1", "n").agg(F.max("best").alias("best"), F.count("*").alias("size")).where("size > 1")
    classes = staged(classes, "warc-classes")
    hot, key = F.broadcast(classes.where(F.col("size") > HOT_ROWS)), ["sha1", "n"]
    ours = rows.select("seq", *key)
    shared = ours.join(hot, key).unionByName(ours.join(hot, key, "left_anti").join(classes.where(F.col("size") <= HOT_ROWS), key))
    return shared.select("seq", (-F.col("best.seq")).alias("keep_seq"), F.col("best.id").alias("keep_id")).where("seq != keep_seq")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write the archives of ``numbered_pages`` into ``folder`` and return the capture lines, one per page."""
    found = rows.join(responses_of(rows, revisit_from), "seq", "left").select("page_id", "seq", "url", "payload", "keep_seq", F.when(F.col("keep_id") != -(2**63), F.col("keep_id")).alias("keep_id"))

    def write(batches):
        import uuid

        name, part, buffer, lines = uuid.uuid4().hex, 0, bytearray(), []

        def flush():
            nonlocal part
            path = f"{folder}/pages-{name}-{part:05d}.warc.gz"
            sharedfs.write_file(path, bytes(buffer))
            out = pa.table([pa.array(list(c), t) for c, t in zip(zip(*[(*x[:6], path, *x[6:]) for x in lines], strict=True), _TYPES, strict=True)], names=_NAMES)
            buffer.clear()
            lines.clear()
            part += 1
            return out.to_batches()

        for batch in batches:
            for page, seq, url, payload, keep_seq, keep in zip(*(batch.column(c).to_pylist() for c in ("page_id", "seq", "url", "payload", "keep_seq", "keep_id")), strict=True):
                digest = digest_of(payload)
                member = gzip.compress(record(page, seq, url, payload, digest, keep, keep_seq), _LEVEL, mtime=0)
                lines.append((page, seq, url_key(url), "response" if keep_seq is None else "revisit", digest, keep, len(buffer), len(member)))
                buffer += member
                if len(buffer) >= archive_bytes:
                    yield from flush()
        if lines:
            yield from flush()

    # The written table names the archives that count: what a lost or doubled task wrote besides is never read.
    return staged(found.mapInArrow(write, _CAPTURE), "warc-lines")


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_NAMES = ["page_id", "seq", "url_key", "record_type", "digest", "refers_to", "archive", "offset", "length"]


def write_index(captures: DataFrame, folder: str, lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """Write the compressed index blocks, and return the sparse directory: ``first_key, file, offset, length, lines``."""
    spark = captures.sparkSession
    line = F.concat_ws("\t", "url_key", F.lit(_EPOCH), F.to_json(F.struct("page_id", "seq", "record_type", "digest", "refers_to", "archive", "offset", "length"), {"ignoreNullFields": "false"}))
    # The id takes part in the order, so one key with very many captures is still cut into ranges.
    ranged = captures.withColumn("line", line).repartitionByRange(shuffle_partitions(spark), *_ORDER).sortWithinPartitions(*_ORDER)

    def blocks(batches):
        import uuid

        name, buffer, rows, pending = uuid.uuid4().hex, bytearray(), [], []
        path = f"{folder}/captures-{name}.idx"

        def close():
            packed = zlib.compress("\n".join(x[3] for x in pending).encode(), _LEVEL)
            rows.append((*pending[0][:3], *pending[-1][:3], path, len(buffer), len(packed), len(pending)))
            buffer.extend(packed)
            pending.clear()

        for batch in batches:
            for entry in zip(*(batch.column(c).to_pylist() for c in (*_ORDER, "line")), strict=True):
                pending.append(entry)
                if len(pending) >= lines_per_block:
                    close()
        if pending:
            close()
        if rows:
            sharedfs.write_file(path, bytes(buffer))
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY)

    made = ranged.select(*_ORDER, "line").mapInArrow(blocks, f"{_ENDS}, file string, offset long, length long, lines long")
    return staged(made, "warc-directory")


_ORDER = ("url_key", "page_id", "seq")
_FIRST, _LAST = ("first_key", "first_id", "first_seq"), ("last_key", "last_id", "last_seq")
_ENDS = "first_key string, first_id long, first_seq long, last_key string, last_id long, last_seq long"
_KEY_TYPES = (pa.string(), pa.int64(), pa.int64())
_ENTRY = pa.schema([*zip((*_FIRST, *_LAST), _KEY_TYPES * 2, strict=True), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())])


def write_directory(directory: DataFrame, path: str, part_lines: int = DIRECTORY_LINES) -> None:
    """Save the sparse directory as sorted parts behind a top file with one line for each part."""
    folder = path

    def parts(batches):
        import uuid

        name, rows, top = uuid.uuid4().hex, [], []

        def close():
            file = f"{folder}/directory-{name}-{len(top):05d}"
            sharedfs.write_file(file, "\n".join(json.dumps(r) for r in rows).encode())
            top.append((*rows[0][:3], *rows[-1][3:6], file))
            rows.clear()

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(list(r))
                if len(rows) >= part_lines:
                    close()
        if rows:
            close()
        if top:
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*top, strict=True), _ENTRY.types[:7], strict=True)], _ENTRY.names[:7])

    n = max(1, -(-directory.count() // part_lines))
    ranged = directory.repartitionByRange(n, *_FIRST).sortWithinPartitions(*_FIRST)
    made = staged(ranged.mapInArrow(parts, f"{_ENDS}, file string"), "warc-top")
    # One line for DIRECTORY_LINES * LINES_PER_BLOCK captures.
    top = sorted((list(r) for r in made.collect()), key=lambda r: _place(*r[:3]))
    sharedfs.write_file(f"{folder}/directory-top", "\n".join(json.dumps(r) for r in top).encode())


def _place(key: str, page_id, seq: int) -> tuple:
    """Where a capture stands in the order of the index: null ids come first."""
    return (key, page_id is not None, page_id or 0, seq)


class _Run:
    """Sorted entries with their first and last places; those that may hold a place are found by binary search."""

    def __init__(self, data: bytes):
        self.entries = [json.loads(x) for x in data.decode().split("\n") if x]
        self.first, self.last = ([_place(*e[a : a + 3]) for e in self.entries] for a in (0, 3))

    def between(self, low: tuple, high: tuple) -> list:
        return self.entries[bisect.bisect_left(self.last, low) : bisect.bisect_right(self.first, high)]


class CaptureIndex:
    """Lookups in a written index; reads the top, one directory part, one block, and record ranges.

    The part and the block read last are kept, so lookups in the order of the index read each of them once.
    """

    def __init__(self, folder: str):
        self.top = _Run(sharedfs.read_file(f"{folder}/directory-top"))
        self._part: tuple = (None, None)
        self._block: tuple = (None, None, None)

    def _captures(self, low: tuple, high: tuple) -> list[dict]:
        found = []
        for *_, part in self.top.between(low, high):
            if self._part[0] != part:
                self._part = (part, _Run(sharedfs.read_file(part)))
            for *_, file, offset, length, _ in self._part[1].between(low, high):
                if self._block[0] != (file, offset):
                    lines = [x.split("\t", 2) for x in zlib.decompress(sharedfs.read_range(file, offset, length)).decode().split("\n")]
                    lines = [(x[0], json.loads(x[2])) for x in lines]
                    self._block = ((file, offset), [_place(k, c["page_id"], c["seq"]) for k, c in lines], [c for _, c in lines])
                _, places, captures = self._block
                found += captures[bisect.bisect_left(places, low) : bisect.bisect_right(places, high)]
        return found

    def lookup(self, url: str) -> list[dict]:
        """All captures of a URL."""
        key = url_key(url)
        return self._captures((key,), (key, 2))

    def lookup_page(self, key: str, page_id, seq: int) -> dict:
        """The capture of one page, by its URL key, id and row number."""
        place = _place(key, page_id, seq)
        found = self._captures(place, place)
        if len(found) != 1:
            raise ValueError(f"the index has {len(found)} captures of page {page_id} at {key}")
        return found[0]

    def fetch(self, capture: dict) -> dict:
        return next(self.fetch_all([capture]))

    @staticmethod
    def fetch_all(captures: list[dict]):
        """The records of the captures, in the order of the archives; neighbours are read by one range."""
        left = sorted(captures, key=lambda c: (c["archive"], c["offset"]))
        while left:
            path, start, end, n = left[0]["archive"], left[0]["offset"], left[0]["offset"] + left[0]["length"], 1
            while n < len(left) and left[n]["archive"] == path and left[n]["offset"] - end <= FETCH_GAP and left[n]["offset"] + left[n]["length"] - start <= FETCH_BYTES:
                end, n = left[n]["offset"] + left[n]["length"], n + 1
            data = sharedfs.read_range(path, start, end - start)
            for c in left[:n]:
                yield parse_record(gzip.decompress(data[c["offset"] - start : c["offset"] - start + c["length"]]))
            left = left[n:]


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORD_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _described(r: dict) -> tuple:
    refers = r.get("WARC-Refers-To", "")
    target = refers.split(":")[2] if refers else ""
    return (
        int(r["X-Page-ID"]) if r["X-Page-ID"] else None, int(r["X-Payload-Length"]) if r["payload"] is None else len(r["payload"]),
        r["WARC-Payload-Digest"].removeprefix("sha1:"), r["WARC-Type"], int(target) if target not in ("", "null") else None,
    )


def read_by_index(pages: DataFrame, folder: str) -> DataFrame:
    """Look up every row of ``numbered_pages`` in the index of ``folder``, and read its record's range of the archive."""
    spark = pages.sparkSession

    def keys(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("page_id"), batch.column("seq")], list(_ORDER))

    def read(batches):
        index = None
        for batch in batches:
            index = index or CaptureIndex(folder)
            wanted = list(zip(*(batch.column(c).to_pylist() for c in _ORDER), strict=True))
            for at in range(0, len(wanted), FETCH_RECORDS):
                rows = [_described(r) for r in index.fetch_all([index.lookup_page(*w) for w in wanted[at : at + FETCH_RECORDS]])]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _RECORD_TYPES, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    asked = pages.select("url", "page_id", "seq").mapInArrow(keys, "url_key string, page_id long, seq long")
    return asked.repartitionByRange(shuffle_partitions(spark), *_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(read, _RECORD)


def read_archives(captures: DataFrame) -> DataFrame:
    """Read every archive named in ``captures`` from its first byte to its last: one row per record."""

    def read(batches):
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                rows = []
                for offset, length, data in _members(sharedfs.read_file(path)):
                    rows.append((*_described(parse_record(data)), path, offset, length))
                types = [*_RECORD_TYPES, pa.string(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"])

    # A list of files is a few bytes; an explicit number of tasks keeps them from being read by one.
    files = captures.select("archive").distinct().repartition(shuffle_partitions(captures.sparkSession), "archive")
    return files.mapInArrow(read, f"{_RECORD}, archive string, offset long, length long")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    pages = numbered_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    write_directory(write_index(write_archives(pages, folder), folder), folder)
    return read_by_index(pages, folder)


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM p WINDOW w AS (PARTITION BY h)
"""
