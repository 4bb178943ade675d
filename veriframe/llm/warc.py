"""WARC archives with revisits, and a salvage reader.

**Writer.** Pages are hashed (SHA-1 of the UTF-8 payload) and counted by digest; only digests, ids and
urls are shuffled. Of records with equal payloads of ``min_bytes`` or more the smallest
(page_id, url) is a ``response``, the others are ``revisit`` records that keep the HTTP header, so the length, and
the digest, and name the response. Each task then writes its rows to archives of about ``FILE_BYTES``,
one gzip member a record, under a temporary name that is renamed; the manifest (a row an
archive) is a table.

**Reader.** An archive is read front to back, a member (gzip) or a version line (plain) at a time, with
these checks: the member inflates and its CRC and length hold; version line, mandatory fields and
Content-Length are there; the block is as long as stated and ends in two line ends; block and payload digests agree. After
a failed check the reader searches for the next member or version line that starts a
record whose own frame holds, goes on there and logs the bytes between as a gap with the reason. A
record whose frame holds but whose content doesn't is quarantined by itself, so a
damaged payload that quotes a WARC record isn't taken for one.

Defined results: a null html is the empty payload; a null page_id is greater than any other and a null url less; repeated rows
give one response and revisits of the same page_id; a null url is written as ``urn:x-no-url``; an
empty table gives no row; other columns are left out. An archive that is missing raises; an
empty one has neither records nor gaps.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.hot_keys import join_groups
from veriframe.llm.storage import AtomicFile, filesystem
from veriframe.session import checkpoint_dir, cut

FILE_BYTES = 64_000_000
MIN_BYTES = 0
STEP = 1 << 20
#: Longest header searched for its end.
HEADER_BYTES = 1 << 20
#: Copies of one row written by one row of the expansion.
CHUNK = 10_000
DATE = "2020-01-01T00:00:00Z"
NO_URL = "urn:x-no-url"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.\d\r?\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.\d\r?\n")
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = (
    "path string, kind string, start long, end long, reason string, record_type string, record_id string, url string, "
    "refers_to_record string, payload_bytes long, payload_digest string, payload binary"
)
COLUMNS = [c.split()[0] for c in RECORDS.split(", ")]
TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]


def label(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def sha1_label(data: bytes) -> str:
    return label(hashlib.sha1(data).digest())


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    """A name made from the page, so that a repeated task writes the same one."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}:{copy}>"


def field(value: str) -> str:
    """A header value on one line: control characters as percent codes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def response_header(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{sha1_label(block)}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + END


def info_record(name: str) -> bytes:
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-archive:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return record(fields, b"format: WARC File Format 1.1\r\n")


def page_record(page_id: int | None, url: str | None, payload: bytes | None, payload_bytes: int, digest: str, first: tuple[int | None, str | None] | None, copy: int = 0) -> bytes:
    """A response, or the revisit of the record of page ``first``."""
    target = NO_URL if url is None else field(url)
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if first:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first[0], digest, 0)), ("WARC-Refers-To-Target-URI", NO_URL if first[1] is None else field(first[1]))]
    return record(fields, response_header(payload_bytes) + (b"" if first else payload or b""))


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


# ---- reading -------------------------------------------------------------------------------


class Damaged(Exception):
    """A failed check; ``end`` is the place after the record where its frame holds all the same."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


class Window:
    """Bytes of an open file from any place on, a step at a time."""

    def __init__(self, file):
        self.file, self.size, self.base, self.data = file, file.size(), 0, b""

    def read(self, start: int, length: int) -> bytes:
        """Up to ``length`` bytes from ``start``; fewer at the end of the file."""
        if not (self.base <= start and start + length <= self.base + len(self.data)):
            self.base = start
            self.data = self.file.read_at(min(max(length, STEP), self.size - start), start) if start < self.size else b""
        return self.data[start - self.base : start - self.base + length]

    def search(self, pattern: re.Pattern[bytes], start: int) -> int | None:
        """Place of the first match at ``start`` or later; patterns are shorter than 16 bytes."""
        while start < self.size:
            piece = self.read(start, STEP)
            m = pattern.search(piece)
            if m:
                return start + m.start()
            if start + len(piece) >= self.size:
                return None
            start += len(piece) - 16
        return None


@dataclass
class Record:
    start: int
    end: int
    fields: dict[str, str]
    block: bytes

    def payload(self) -> bytes:
        """The block without its HTTP header, where it has one."""
        return self.split()[1]

    def split(self) -> tuple[bytes, bytes]:
        if self.fields.get("content-type", "").startswith("application/http"):
            head, mark, body = self.block.partition(END)
            if mark:
                return head, body
        return b"", self.block


def fields_of(head: bytes) -> dict[str, str]:
    """Named fields in lower case; lines that start with white space go on with the one before."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\n")[1:]:
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif line:
            key, mark, value = line.partition(":")
            if not mark:
                raise Damaged("header line without a colon")
            name = key.strip().lower()
            out[name] = value.strip()
    return out


def head_of(data: bytes) -> tuple[dict[str, str], int, int]:
    """Fields, length of the header and stated length of the block."""
    if not VERSION.match(data):
        raise Damaged("no version line")
    end = data.find(END)
    if end < 0:
        raise Damaged("header without an end")
    fields = fields_of(data[:end])
    if not all(fields.get(k) for k in ("warc-type", "warc-record-id", "warc-date")) or not fields.get("content-length", "").isdecimal():
        raise Damaged("mandatory field missing")
    return fields, end + 4, int(fields["content-length"])


def agrees(stated: str | None, data: bytes) -> bool:
    """Whether a labelled digest is that of the data; unknown algorithms pass."""
    algorithm, mark, value = (stated or "").partition(":")
    if not mark or algorithm.lower() not in ("sha1", "md5", "sha256"):
        return True
    digest = hashlib.new(algorithm.lower(), data).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == label(digest).rstrip("=")


def checked(found: Record) -> Record:
    """The record if its digests agree."""
    if not agrees(found.fields.get("warc-block-digest"), found.block):
        raise Damaged("block digest differs", found.end)
    if found.fields["warc-type"] == "response" and not agrees(found.fields.get("warc-payload-digest"), found.payload()):
        raise Damaged("payload digest differs", found.end)
    return found


def member_at(window: Window, start: int) -> Record:
    """The record of the gzip member that starts here."""
    inflate, parts, at, known = zlib.decompressobj(31), [], start, False
    while not inflate.eof:
        piece = window.read(at, STEP)
        if not piece:
            raise Damaged("member without an end")
        try:
            parts.append(inflate.decompress(piece))
        except zlib.error as error:
            raise Damaged(f"member doesn't inflate: {str(error)[:60]}") from None
        at += len(piece)
        if not known and sum(map(len, parts)) >= 16:
            known = True
            if not VERSION.match(b"".join(parts)[:16]):
                raise Damaged("member without a version line")
    end, data = at - len(inflate.unused_data), b"".join(parts)
    try:
        fields, head, length = head_of(data)
    except Damaged as error:
        raise Damaged(error.reason, end) from None
    if data[head + length :] != END:
        raise Damaged("block length differs", end)
    return checked(Record(start, end, fields, data[head : head + length]))


def plain_at(window: Window, start: int) -> Record:
    """The uncompressed record that starts here."""
    fields, head, length = head_of(window.read(start, HEADER_BYTES))
    end = start + head + length + 4
    if end > window.size or window.read(end - 4, 4) != END:
        raise Damaged("block length differs")
    return checked(Record(start, end, fields, window.read(start + head, length)))


def record_at(window: Window, start: int) -> Record:
    first = window.read(start, 16)
    if first.startswith(b"\x1f\x8b"):
        return member_at(window, start)
    if first.startswith(b"WARC/"):
        return plain_at(window, start)
    raise Damaged("neither a member nor a version line")


def salvage(file) -> Iterator[Record | tuple[int, int, str]]:
    """All records that pass the checks, and (start, end, reason) of the gaps between them, in order."""
    window, at = Window(file), 0
    gap: tuple[int, str] | None = None
    while at < window.size:
        try:
            found = record_at(window, at)
        except Damaged as failed:
            gap = gap or (at, failed.reason)
            # A frame that holds is left as a whole; else every later start is tried.
            at = failed.end if failed.end is not None else window.search(START, at + 1)
            if at is None:
                break
            continue
        if gap:
            yield gap[0], at, gap[1]
            gap = None
        yield found
        at = found.end
    if gap:
        yield gap[0], window.size, gap[1]


def stated_length(head: bytes) -> int | None:
    m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
    return int(m.group(1)) if m else None


def row_of(path: str, found: Record | tuple[int, int, str], with_payload: bool) -> tuple:
    if isinstance(found, tuple):
        return (path, "gap", *found, None, None, None, None, None, None, None)
    f, (head, payload) = found.fields, found.split()
    kind, url = f["warc-type"], f.get("warc-target-uri")
    if kind == "revisit":  # the payload lies elsewhere: length and digest as recorded
        size, digest = stated_length(head), f.get("warc-payload-digest", "").partition(":")[2] or None
    else:
        size, digest = len(payload), sha1_label(payload)
    kept = payload if with_payload and kind != "revisit" else None
    return (path, "record", found.start, found.end, None, kind, f["warc-record-id"], None if url == NO_URL else url, f.get("warc-refers-to"), size, digest, kept)


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records and gaps of every archive named in column ``path``, told apart by ``kind``; an archive is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = filesystem(path)
                with store.open_input_file(name) as file:
                    rows, held = [], 0
                    for found in salvage(file):
                        rows.append(row_of(path, found, with_payload))
                        held += 200 + len(rows[-1][-1] or b"")
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], COLUMNS)
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(TYPES), TYPES, strict=True)], COLUMNS)

    paths = archives.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, RECORDS)


# ---- writing -------------------------------------------------------------------------------


def classified(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, copy and the page whose record a revisit names (``first``, null for responses)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNotNull(), "url")
    each = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    head = F.min_by(F.struct("page_id", "url", "n"), order).alias("head")
    groups = cut(each.groupBy("digest").agg(F.sum("n").alias("size"), head).where("size > 1").select("digest", "size", "head"))
    joined = join_groups(rows, groups, "digest", "size")
    is_head = F.col("page_id").eqNullSafe(F.col("head.page_id")) & F.col("url").eqNullSafe(F.col("head.url"))
    known = joined.select(*rows.columns, "head", (F.col("head").isNotNull() & is_head).alias("is_head"))
    first = F.when(F.col("head").isNotNull() & ~F.col("is_head"), F.struct("head.page_id", "head.url"))
    plain = known.where(~F.col("is_head") | (F.col("head.n") == 1)).select(*rows.columns, F.lit(0).cast("long").alias("copy"), first.alias("first"))
    if groups.where("head.n > 1").isEmpty():
        return plain
    # Rows alike in everything: counted, then one response and revisits of it.
    alike = known.where(F.col("is_head") & (F.col("head.n") > 1))
    alike = alike.groupBy("digest").agg(*[F.any_value(c).alias(c) for c in ("page_id", "url", "payload")], F.any_value("head.n").alias("n"))
    alike = cut(alike.select(*rows.columns, "n"))
    response = alike.select(*rows.columns, F.lit(0).cast("long").alias("copy"), F.lit(None).cast("struct<page_id:bigint,url:string>").alias("first"))
    one = F.lit(1).cast("long")
    parts = alike.select("page_id", "url", F.octet_length("payload").alias("bytes"), "digest", "n", F.explode(F.sequence(one, F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("part"))
    each = F.explode(F.sequence(F.col("part"), F.least(F.col("part") + (CHUNK - 1), F.col("n") - 1)))
    copies = parts.repartition("digest", "part").select("page_id", "url", "bytes", "digest", each.alias("copy"))
    whole = plain.unionByName(response).withColumn("bytes", F.octet_length("payload"))
    copies = copies.withColumn("payload", F.lit(None).cast("binary")).withColumn("first", F.struct("page_id", "url"))
    return whole.unionByName(copies).select(*plain.columns, "bytes")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, compressed: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages; returns the manifest, a row an archive."""
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, part, out, written = TaskContext.get().partitionId(), 0, None, []
        wrap = member if compressed else bytes
        count = 0
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, digest, copy, first, size = (batch.column(c)[k].as_py() for c in range(7))
                if out is None:
                    name = f"part-{task:06d}-{part:05d}.warc{'.gz' if compressed else ''}"
                    out, count = AtomicFile(f"{folder}/archives/{name}"), 0
                    out.write(wrap(info_record(name)))
                target = (first["page_id"], first["url"]) if first else None
                out.write(wrap(page_record(page_id, url, payload, size, label(digest), target, copy)))
                count += 1
                if out.size >= file_bytes:
                    out.close()
                    written.append((f"{folder}/archives/{name}", count, out.size))
                    out, part = None, part + 1
        if out is not None:
            out.close()
            written.append((f"{folder}/archives/{name}", count, out.size))
        columns = list(zip(*written, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "n_records", "n_bytes"])

    rows = classified(pages, min_bytes)
    if "bytes" not in rows.columns:
        rows = rows.withColumn("bytes", F.octet_length("payload"))
    rows = rows.select("page_id", "url", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"), "digest", "copy", "first", F.col("bytes").cast("long"))
    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def page_of(record: str) -> F.Column:
    """The page_id in a record's name; null if the page has none."""
    return F.regexp_extract(record, r"^<urn:x-page:(-?\d*):", 1).try_cast("long")


def archive_round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back; raises if a record is lost."""
    folder = f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(pages, folder, min_bytes)
    records = read_archives(manifest)
    lost = F.raise_error(F.concat(F.lit("gap in "), F.col("path"), F.lit(": "), F.col("reason")))
    records = records.where(F.when(F.col("kind") == "gap", lost.cast("boolean")).otherwise(F.col("record_type").isin("response", "revisit")))
    return records.select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to_record").alias("refers_to")
    )


#: Base 32 of the 160 bits: five bits at a time from two hex digits.
_LETTERS = "(list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (('0x' || substr(h || '0', (1 + 5 * i // 4)::BIGINT, 2))::INT >> (3 - 5 * i % 4)::INT) % 32)::BIGINT, 1)), 'string_agg', ''))"
ORACLE = f"""
WITH h AS (SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, url, payload_bytes, {_LETTERS} AS payload_digest FROM h),
o AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS first_id FROM d WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS FIRST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first_id END AS refers_to
FROM o"""
