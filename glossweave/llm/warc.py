"""WARC archives: distributed writing with revisit records, and a reader that salvages what damage has left.

*Writing.* Pages with equal payloads are found by one aggregate over digests; the page with the smallest id is written as
``response``, the others as ``revisit``. Each task writes archives of its own, one gzip member a record, in a folder that all
executors share, and reports them in a manifest; archives of a task that was lost are in no manifest and never read.

*Reading.* A record counts if its member's own checksum, its header, length, closing line and digests hold. After a failed check
the reader looks from the next byte on for a gzip member or a version line that begins a valid record, goes on there, and
reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.session import materialise, scratch_path

#: An archive is closed when it has this many bytes; a longer record still fits in one.
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 1 << 18
MAGIC, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = "archive string, offset long, length long, problem string, record_type string, page_id string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}|{digest}')}>"


def build_record(page: str | None, url: str | None, payload: bytes, first: str | None, date: str) -> bytes:
    """One record; ``first`` is the page whose response holds the payload, for a revisit."""
    digest = sha1_base32(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if first is not None else head + payload
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("X-Page-ID", page)]
    if first is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page-ID", first)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, start: int = 0) -> tuple[dict | str, int]:
    """(fields of the record at ``start``, its end), or (what is wrong, start)."""
    version = VERSION.match(data, start)
    if not version:
        return "no version line", start
    end = data.find(b"\r\n\r\n", start)
    if end < 0:
        return "header without end", start
    fields = {}
    for line in data[version.end():end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "header line without colon", start
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return "no content length", start
    block_at = end + 4
    stop = block_at + int(length)
    if data[stop:stop + 4] != b"\r\n\r\n":
        return "closing line missing", start
    block = data[block_at:stop]
    said = fields.get(b"warc-block-digest")
    if said and said != b"sha1:" + sha1_base32(block).encode():
        return "block digest differs", start
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    text = lambda k: None if k not in fields else fields[k].decode("utf-8", "replace")
    out = {
        "record_type": kind, "page_id": text(b"x-page-id"), "url": text(b"warc-target-uri"), "refers_to": text(b"x-refers-to-page-id"),
        "payload_digest": (text(b"warc-payload-digest") or "").removeprefix("sha1:") or None, "payload": None, "payload_bytes": None}
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        if kind == "response":
            digest = sha1_base32(payload)
            if out["payload_digest"] not in (None, digest):
                return "payload digest differs", start
            out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}
        elif stated:
            out["payload_bytes"] = int(stated[1])
    return out, stop + 4


class Archive:
    """Bytes of one archive, read in parts."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, self.size - at))

    def member(self, at: int) -> tuple[bytes | None, int]:
        """(content, end) of the gzip member at ``at``; content None if it is damaged or cut off."""
        inflate, parts, place = zlib.decompressobj(31), [], at
        try:
            while not inflate.eof and place < self.size:
                chunk = self.read(place, READ_BYTES)
                place += len(chunk)
                parts.append(inflate.decompress(chunk))
        except zlib.error:
            return None, at
        return (b"".join(parts), place - len(inflate.unused_data)) if inflate.eof else (None, at)

    def plain(self, at: int) -> tuple[dict | str, int]:
        """The uncompressed record at ``at``: reads on until its stated length is there."""
        n = READ_BYTES
        while True:
            data = self.read(at, n)
            found, end = parse_record(data)
            if not isinstance(found, str):
                return found, at + end
            head = data.find(b"\r\n\r\n")
            length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", data[:max(head, 0)])
            need = head + 8 + int(length[1]) if length else n + 1 if head < 0 and n < READ_BYTES * 8 else 0
            if need <= n or at + n >= self.size:
                return found, at
            n = min(max(need, 2 * n), self.size - at)

    def next_sign(self, at: int) -> int:
        """The next place from ``at`` on where a member or a version line may begin; the archive's end if none."""
        while at < self.size:
            data = self.read(at, READ_BYTES)
            line = VERSION.search(data)
            places = [p for p in (data.find(MAGIC), line.start() if line else -1) if p >= 0]
            if places:
                return at + min(places)
            if at + len(data) >= self.size:
                break
            at += len(data) - 16
        return self.size

    def entries(self) -> Iterator[dict]:
        """Records and gaps in order of their place; together they cover the archive."""
        at, gap, why = 0, None, None
        while at < self.size:
            sign = self.read(at, 3)
            problem, found, end = "neither member nor version line", [], at
            if sign == MAGIC:
                content, end = self.member(at)
                problem = "damaged or cut off member"
                if content is not None:
                    place, problem = 0, None
                    while place < len(content):
                        record, place_end = parse_record(content, place)
                        if isinstance(record, str):
                            problem = record
                            break
                        found.append(record)
                        place = place_end
            elif sign.startswith(b"WAR"):
                record, end = self.plain(at)
                problem, found = (record, []) if isinstance(record, str) else (None, [record])
            if found or problem is None:
                if gap is not None:
                    yield {"offset": gap, "length": at - gap, "problem": why}
                    gap = None
                for record in found:
                    yield {"offset": at, "length": end - at, "problem": None} | record
                if problem:  # the rest of a member with a good beginning
                    yield {"offset": at, "length": end - at, "problem": problem}
                at = end
                continue
            if gap is None:
                gap, why = at, problem
            at = self.next_sign(at + 1)
        if gap is not None:
            yield {"offset": gap, "length": self.size - gap, "problem": why}


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str | None = None) -> DataFrame:
    """Write a record for each row; the manifest (archive, records, bytes) of what was written.

    Of rows with equal payloads of at least ``least`` bytes, those with the smallest key are responses, the others revisit it.
    Null payload: empty. Null key: a response only if its whole group has none. Repeated rows each give a record. A hot
    payload is a few partial results for the aggregate, and the join's side with many rows can be split.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    content = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    hashed = pages.select(F.col(key).alias("k"), F.sha2(content, 256).alias("h"), F.length(content).alias("n"))
    firsts = hashed.filter(F.col("n") >= least).groupBy("h").agg(F.min("k").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), content.alias("p"), F.sha2(content, 256).alias("h")).join(firsts, "h", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    rows = rows.select(F.col("k").cast("string").alias("k"), "u", "p", refers.alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        out = name = None
        records = written = 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for k, u, p, r in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, records, written = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = squeeze.compress(build_record(k, u, p, r, date)) + squeeze.flush()
                out.write(member)
                records, written = records + 1, written + len(member)
                if written >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, records, written))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, written))
        yield pa.RecordBatch.from_pylist([dict(zip(("archive", "records", "bytes"), d)) for d in done], pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return rows.mapInArrow(run, "archive string, records long, bytes long")


def read_archives(names: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives named in column ``archive``: see RECORD. One archive is one unit of work.

    A row with ``problem`` is a quarantined gap: offset and length say which bytes could not be read as records. Ids are
    text, as in the records. No archives: no rows.
    """
    n = max(1, names.count())
    archives = names.select("archive").repartition(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        kinds = {"offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        order = [x.split()[0] for x in RECORD.split(", ")]
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in order])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{root}/{name}") as file:
                    held, size = [], 0
                    for entry in Archive(file, file.size()).entries():
                        if not payloads:
                            entry["payload"] = None
                        held.append({"archive": name} | entry)
                        size += len(entry.get("payload") or b"") + 400
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    return archives.mapInArrow(run, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Archives of all pages, written and read back: the records as the reader found them, without payloads."""
    folder = folder or scratch_path(spark, "warc")
    manifest = materialise(write_archives(pages, folder, **columns), "warc-manifest")
    return read_archives(manifest, folder, payloads=False)


#: The same rows from the table; base32 is written out from the digest's bits, five at a time.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT h, n, min(page_id) AS first FROM d GROUP BY h, n),
bits AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(h, CAST(1 + (i * 5) // 4 AS BIGINT), 2) || CASE WHEN 1 + (i * 5) // 4 = 40 THEN '0' ELSE '' END AS BIGINT)
      >> CAST(3 - (i * 5) % 4 AS INTEGER)) % 32 AS BIGINT), 1), '' ORDER BY i) AS digest
  FROM (SELECT DISTINCT h FROM d), range(32) t(i) GROUP BY h)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, bits.digest AS payload_digest,
  CASE WHEN d.page_id IS NOT DISTINCT FROM g.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id IS NOT DISTINCT FROM g.first THEN NULL ELSE g.first END AS refers_to
FROM d JOIN g USING (h, n) JOIN bits USING (h)
"""
