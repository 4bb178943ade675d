"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames of at most ``FRAME_BYTES`` bytes, cut
between code points, with cumulative counts of units, code points and bytes before each
frame. A unit is ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+`` or the white space at the end; units are
counted by their first character, so a frame may end inside one and a very long unit spans
frames. To find a cut the frame that holds it is the only one decompressed; digests are
taken from a stream of frames in the order of the form, one frame in memory at a time. The
output is put in frames of its own, and the text is rebuilt from it and the form alone: the
marks are searched in the stream of output frames, then the parts are streamed in their
first order.

Parameters of the form and of the cuts come from the SHA-256 of ``<seed>:<doc_id>``.

Defined results: a null text is empty; a null doc_id is written as the empty text; repeated rows are
treated each by itself and come out alike; empty texts and texts that contain a mark are
plain; a text without white space is one unit; an empty table gives no row; other columns
are left out.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.session import checkpoint_dir

SEED = 42
FRAME_BYTES = 32_768
LEVEL = 1
FIM_PERCENT = 50
SPM_PERCENT = 80
#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = re.compile(rb"<[PSM]>")
BLANKS = b" \t\n\x0b\x0c\r"
UNIT_START = re.compile(rb"(?<=[^\x20\x09-\x0d])[\x20\x09-\x0d]")
FRAMES = "doc_id long, n long, marked boolean, units array<long>, chars array<long>, bytes array<long>, at array<long>, data binary"


def code_points(data: bytes) -> int:
    return len(data.decode("utf-8", "surrogatepass"))


class Frames:
    """A text as compressed frames; ``units``, ``chars``, ``bytes`` and ``at`` count what lies before each frame and in all."""

    def __init__(self, units: list[int], chars: list[int], sizes: list[int], at: list[int], data: bytes | bytearray):
        self.units, self.chars, self.bytes, self.at, self.data = units, chars, sizes, at, memoryview(data)

    @classmethod
    def build(cls, stream: Iterator[bytes], frame_bytes: int = FRAME_BYTES) -> Frames:
        """Frames of a stream of UTF-8 pieces; pieces need not end between code points."""
        zip_up = compressor().compress
        units, chars, sizes, at, data = [0], [0], [0], [0], bytearray()
        held, blank_before, started = b"", True, False

        def add(frame: bytes) -> None:
            nonlocal blank_before, started
            # Runs of other characters, less one that goes on from the frame before; then white space after a run.
            starts = len(UNIT_START.findall(frame)) + (not started or (not blank_before and frame[0] in BLANKS))
            blank_before, started = frame[-1] in BLANKS, True
            units.append(units[-1] + starts)
            chars.append(chars[-1] + code_points(frame))
            sizes.append(sizes[-1] + len(frame))
            data.extend(zip_up(frame))
            at.append(len(data))

        for piece in stream:
            held += piece
            start = 0
            while len(held) - start > frame_bytes:
                end = start + frame_bytes
                while held[end] & 0xC0 == 0x80:
                    end -= 1
                add(held[start:end])
                start = end
            held = held[start:]
        if held:
            add(held)
        return cls(units, chars, sizes, at, data)

    def frame(self, k: int) -> bytes:
        return decompressor().decompress(self.data[self.at[k] : self.at[k + 1]])

    def unit_at(self, u: int) -> tuple[int, int]:
        """(bytes, code points) before unit ``u``; one frame is decompressed."""
        if u >= self.units[-1]:
            return self.bytes[-1], self.chars[-1]
        if u == 0:
            return 0, 0
        k = bisect_right(self.units, u) - 1
        text, within = self.frame(k), u - self.units[k]
        # A white space at the head of a frame starts a unit if the frame before ends on another character.
        head = self.units[k + 1] - self.units[k] - len(UNIT_START.findall(text))
        place = 0 if head and within == 0 else next(islice(UNIT_START.finditer(text), within - head, None)).start()
        return self.bytes[k] + place, self.chars[k] + code_points(text[:place])

    def stream(self, start: int, end: int) -> Iterator[bytes]:
        """Bytes from ``start`` to ``end``, a frame at a time."""
        k = max(0, bisect_right(self.bytes, start) - 1)
        while start < end:
            text = self.frame(k)
            part = text[start - self.bytes[k] : end - self.bytes[k]]
            yield part
            start, k = start + len(part), k + 1


_TOOLS: dict[str, object] = {}


def compressor():
    if "c" not in _TOOLS:
        import zstandard

        _TOOLS["c"] = zstandard.ZstdCompressor(level=LEVEL)
    return _TOOLS["c"]


def decompressor():
    if "d" not in _TOOLS:
        import zstandard

        _TOOLS["d"] = zstandard.ZstdDecompressor()
    return _TOOLS["d"]


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The first four 8-digit groups of the SHA-256 of ``<seed>:<doc_id>``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


class Plan:
    """Form and cuts of one stored text."""

    def __init__(self, doc_id: int | None, n: int, marked: bool, text: Frames, seed: int = SEED):
        h1, h2, h3, h4 = draws(doc_id, seed)
        self.text, whole = text, text.bytes[-1]
        self.form, self.prefix_chars, self.middle_chars = "plain", None, None
        self.parts: list[tuple[bytes, int, int]] = [(b"", 0, whole)]
        if n and not marked and h3 % 100 < FIM_PERCENT:
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            (first, before), (second, until) = text.unit_at(low), text.unit_at(high)
            self.prefix_chars, self.middle_chars = before, until - before
            prefix, middle, suffix = (PREFIX, 0, first), (MIDDLE, first, second), (SUFFIX, second, whole)
            self.form = "spm" if h4 % 100 < SPM_PERCENT else "psm"
            self.parts = [suffix, prefix, middle] if self.form == "spm" else [prefix, suffix, middle]

    def output(self) -> Iterator[bytes]:
        for mark, start, end in self.parts:
            if mark:
                yield mark
            yield from self.text.stream(start, end)


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text again, from the frames of the output and the form."""
    whole = output.bytes[-1]
    if form == "plain":
        yield from output.stream(0, whole)
        return
    found: dict[bytes, int] = {}
    at, tail = 0, b""
    for piece in output.stream(0, whole):
        seen = tail + piece
        for m in MARKS.finditer(seen):
            found[m.group()] = at - len(tail) + m.start()
        at, tail = at + len(piece), seen[-2:]
    order = sorted(found.items(), key=lambda f: f[1])
    ends = [start for _, start in order[1:]] + [whole]
    span = {mark: (start + len(mark), end) for (mark, start), end in zip(order, ends, strict=True)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(*span[mark])


def sha256_of(stream: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in stream:
        digest.update(piece)
    return digest.hexdigest()


def write_frames(docs: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Store the texts of ``docs`` as frames, a row a document, and read the stored table."""
    names = ["doc_id", "n", "marked", "units", "chars", "bytes", "at", "data"]
    longs = pa.list_(pa.int64())
    types = [pa.int64(), pa.int64(), pa.bool_(), longs, longs, longs, longs, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = value.as_py() or b""
                f = Frames.build(iter((data,)), frame_bytes)
                rows.append((doc_id, f.units[-1], bool(MARKS.search(data)), f.units, f.chars, f.bytes, f.at, bytes(f.data)))
                held += len(f.data)
                if held > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 8, types, strict=True)], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    texts.mapInArrow(run, FRAMES).write.option("compression", "none").parquet(folder)
    return docs.sparkSession.read.schema(FRAMES).parquet(folder)


def transform(stored: DataFrame, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """Form, cuts and digests of every stored text; ``with_text`` adds the output itself as ``output``."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] + ["output"] * with_text
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.string()] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                doc_id, n, marked, units, chars, sizes, at, data = (batch.column(c)[k].as_py() for c in range(8))
                plan = Plan(doc_id, n, marked, Frames(units, chars, sizes, at, data), seed)
                output = Frames.build(plan.output())
                row = (doc_id, n, plan.form, plan.prefix_chars, plan.middle_chars, sha256_of(plan.output()), sha256_of(restored(output, plan.form)))
                out.append(row + (b"".join(plan.output()).decode(),) if with_text else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(types), types, strict=True)], names)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return stored.mapInArrow(run, schema + ", output string" * with_text)


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Store all documents as frames in the shared folder and transform them from there."""
    folder = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/frames-{uuid.uuid4().hex}"
    return transform(write_frames(docs, folder), seed)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units FROM documents),
e AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain'
         WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (
  SELECT *, array_to_string(units[1:low], '') AS p, array_to_string(units[low + 1:high], '') AS m, array_to_string(units[high + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM g"""
