"""Token files of directly addressable codes.

A file holds segments. A segment splits every id into chunks of ``WIDTH`` bits, lowest
first, one level per chunk. Level k keeps the chunk of each id that has one, as a byte, and
a continuation bitmap: whether that id goes on at level k + 1. A rank directory counts the
set bits before every block of 512, so the place of an id on the next level is a directory entry plus a
few popcounts: any token is read by itself, without decoding a block.

    file    = segment* , directory (npy arrays), footer: directory offset, its length, magic
    segment = per level: chunk bytes, bitmap, rank directory (uint32)

Documents lie in ascending doc_id order. Files have names made from their content's place,
are written under a temporary name and renamed, so a repeated task replaces its own file.

Defined results: null text is the end id alone; a null doc_id comes first; ties are ordered
by a hash of the text, then the text; an empty table gives no row. Other columns are
ignored.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.tokens import vocabulary_path, word_ids
from veriframe.session import checkpoint_dir

WIDTH = 8
BLOCK = 512
SEGMENT_TOKENS = 1 << 20
END_ID = 1
MAGIC = b"VFDAC001"
ENTRY = "path string, first_id long, null_ids boolean, n_docs long, n_tokens long"


class Level:
    """Chunks, continuation bitmap and rank directory of one level."""

    def __init__(self, chunks: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bits, self.ranks = chunks, bits, ranks

    @classmethod
    def build(cls, chunks: np.ndarray, goes_on: np.ndarray) -> Level:
        bits = np.packbits(goes_on, bitorder="little")
        padded = np.zeros(-(-len(goes_on) // BLOCK) * BLOCK, dtype=bool)
        padded[: len(goes_on)] = goes_on
        counts = padded.reshape(-1, BLOCK).sum(axis=1)
        return cls(chunks, bits, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4") if len(counts) else np.zeros(0, "<u4"))

    def follows(self, i: int) -> bool:
        return bool(self.bits[i >> 3] >> (i & 7) & 1)

    def rank(self, i: int) -> int:
        """Set bits before position i."""
        block = i // BLOCK
        start, end = block * BLOCK // 8, i >> 3
        before = int(np.bitwise_count(self.bits[start:end]).sum()) if end > start else 0
        rest = int(self.bits[i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(self.ranks[block]) + before + rest.bit_count()


def encode_levels(ids: np.ndarray, width: int = WIDTH) -> list[Level]:
    levels, rest = [], ids.astype(np.uint64)
    while True:
        more = rest >> np.uint64(width)
        goes_on = more > 0
        levels.append(Level.build((rest & np.uint64((1 << width) - 1)).astype(np.uint8), goes_on))
        if not goes_on.any():
            return levels
        rest = more[goes_on]


def token_at(levels: list[Level], i: int, width: int = WIDTH) -> int:
    """The i-th id by itself: one chunk, one bit and one rank per level."""
    value, shift = 0, 0
    for level in levels:
        value |= int(level.chunks[i]) << shift
        if not level.follows(i):
            break
        i, shift = level.rank(i), shift + width
    return value


def decode_levels(levels: list[Level], width: int = WIDTH) -> np.ndarray:
    """All ids of a segment, from the last level up."""
    values = np.zeros(0, dtype=np.uint32)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        own = level.chunks.astype(np.uint32)
        if len(values):
            goes_on = np.unpackbits(level.bits, count=len(own), bitorder="little").astype(bool)
            own[goes_on] |= values << np.uint32(width)
        values = own
    return values.astype("<u4")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class FileWriter:
    """Writes documents' ids to one file, a segment at a time."""

    def __init__(self, path: str):
        self.fs, self.final = _filesystem(path)
        self.fs.create_dir(self.final.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.final}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.docs: list[tuple[int, bool, int]] = []
        self.parts: list[bytes] = []
        self.held, self.at, self.total = 0, 0, 0
        self.segments: list[list[int]] = []  # tokens before, then offset, chunks, bit bytes, ranks of each level

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.parts.append(ids)
        self.held += len(ids) // 4
        while self.held >= SEGMENT_TOKENS:
            self._flush(SEGMENT_TOKENS)

    def _flush(self, count: int) -> None:
        data = b"".join(self.parts)
        self.parts = [data[4 * count :]]
        self.held -= min(count, self.held)
        ids = np.frombuffer(data[: 4 * count], dtype="<u4")
        entry = [self.total]
        for level in encode_levels(ids):
            entry += [self.at, len(level.chunks), len(level.bits), len(level.ranks)]
            for piece in (level.chunks.tobytes(), level.bits.tobytes(), level.ranks.tobytes()):
                self.out.write(piece)
                self.at += len(piece)
        self.total += len(ids)
        self.segments.append(entry)

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        width = max(map(len, self.segments), default=1)
        table = np.array([s + [0] * (width - len(s)) for s in self.segments], dtype="<i8").reshape(-1, width)
        buffer = io.BytesIO()
        for array in (np.array([d[0] for d in self.docs], "<i8"), np.array([d[1] for d in self.docs], bool), np.array([d[2] for d in self.docs], "<i8"), table):
            np.save(buffer, array, allow_pickle=False)
        directory = buffer.getvalue()
        self.out.write(directory + np.array([self.at, len(directory)], "<i8").tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.final)


class FileReader:
    """Random and sequential access to a file; reads only the ranges it needs."""

    def __init__(self, path: str):
        self.fs, name = _filesystem(path)
        self.file = self.fs.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(24, size - 24)
        if tail[16:] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        at, length = np.frombuffer(tail[:16], "<i8")
        buffer = io.BytesIO(self.file.read_at(int(length), int(at)))
        self.doc_ids, self.nulls, self.lengths, self.segments = (np.load(buffer, allow_pickle=False) for _ in range(4))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def levels(self, segment: int) -> list[Level]:
        entry, out = self.segments[segment][1:], []
        for at, chunks, bits, ranks in entry.reshape(-1, 4):
            if chunks:
                data = self.file.read_at(int(chunks + bits + 4 * ranks), int(at))
                out.append(Level(np.frombuffer(data, np.uint8, chunks), np.frombuffer(data, np.uint8, bits, chunks), np.frombuffer(data, "<u4", ranks, chunks + bits)))
        return out

    def token(self, i: int) -> int:
        """The i-th id of the file: a chunk, a bitmap block and a directory entry read per level."""
        segment = int(np.searchsorted(self.segments[:, 0], i, side="right")) - 1
        i -= int(self.segments[segment, 0])
        value, shift = 0, 0
        for at, chunks, bits, _ in self.segments[segment][1:].reshape(-1, 4).tolist():
            value |= self.file.read_at(1, at + i)[0] << shift
            block = i // BLOCK
            start = block * BLOCK // 8
            own = int.from_bytes(self.file.read_at((i >> 3) + 1 - start, at + chunks + start), "little")
            place = i - block * BLOCK
            if not own >> place & 1:
                break
            before = int.from_bytes(self.file.read_at(4, at + chunks + bits + 4 * block), "little")
            i, shift = before + (own & ((1 << place) - 1)).bit_count(), shift + WIDTH
        return value

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id in the file, ids) of every document."""
        segment, base, held = 0, 0, np.zeros(0, "<u4")
        for k in range(len(self.doc_ids)):
            start, end = int(self.starts[k]), int(self.starts[k + 1])
            parts = []
            while base + len(held) < end:
                parts.append(held)
                fresh = decode_levels(self.levels(segment))
                base, held, segment = base, np.concatenate([*parts, fresh]), segment + 1
                parts = []
            ids = held[start - base : end - base]
            yield (None if self.nulls[k] else int(self.doc_ids[k])), start, ids
            if end - base > SEGMENT_TOKENS:
                held, base = held[end - base :], end

    def verified(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``documents``, each compared with its middle and last id as read by themselves."""
        for doc_id, at, ids in self.documents():
            for i in {len(ids) // 2, len(ids) - 1} if len(ids) else ():
                if self.token(at + i) != int(ids[i]):
                    raise ValueError(f"id {at + i} differs when read by itself")
            yield doc_id, at, ids


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the files; returns the manifest, one row per file in doc_id order."""
    path = path or vocabulary_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, coder, first = None, word_ids(path), None
        name = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():06d}.dac"
        for batch in batches:
            texts = batch.column(1)
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if writer is None:
                    writer, first = FileWriter(name), doc_id
                writer.add(doc_id, coder.encode(text.as_py()) + end)
        if writer is not None:
            writer.close()
            row = [[name], [first], [first is None], [len(writer.docs)], [writer.total]]
            types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], ["path", "first_id", "null_ids", "n_docs", "n_tokens"])

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("text")]
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("_h")).sortWithinPartitions(*order)
    manifest = f"{folder.rstrip('/')}/manifest"
    dealt.select("doc_id", "text").mapInArrow(run, ENTRY).write.mode("overwrite").parquet(manifest)
    return spark.read.parquet(manifest)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("_before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    files = files.select("path", "_before").repartition(max(1, manifest.count()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(d, before + at, len(ids), zlib.crc32(ids.tobytes())) for d, at, ids in FileReader(name).verified()]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame) -> DataFrame:
    """Write all documents to token files in the shared folder and read them back."""
    folder = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(docs, folder))
