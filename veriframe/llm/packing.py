"""Packing of token sequences: best fit, then a swap-based local search.

Texts become ids with an end id; only those longer than a sequence are cut, into full
pieces and a rest. Pieces are dealt by hash to groups of some twenty thousand, each packed
in a task: first best fit by falling length, then a local search over the underfull bins.
The search moves a piece to a fuller bin, exchanges one piece for one, or two for one,
whenever that raises the sum of squared fills; so bins drain until some are empty. It ends
at a local optimum, or once the count of bins equals the lower bound of the group.
Pieces of the bins that all groups leave at ``OPEN_FILL`` of a sequence or less are then
gathered, dealt anew and packed again, until no bin empties or one group holds them all.

Defined results: a null or empty text is the end id alone; repeated rows (null ids too) are
packed each for itself; an empty table gives no piece. Columns beyond ``doc_id`` and
``text`` are left out of the result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.tokens import vocabulary_path, word_ids
from veriframe.session import cut

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 20_000
OPEN_FILL = 0.95
BROADCAST_BINS = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, tag long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document; ``tag`` numbers the rows of the input."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        for batch in batches:
            rows = []
            texts = batch.column(1)
            for doc_id, text, tag in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                data = coder.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), tag))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "tag")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("tag"))
    return rows.mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: each piece, longest first, into the fullest bin that takes it."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room left, bin), ascending
    for i in order:
        size = lengths[i]
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > size:
            insort(rooms, (room - size, b))
    return bins


def local_search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Drain the emptiest bins into the other underfull ones by moves and exchanges.

    An exchange gives a fuller bin more tokens than it takes back, so the squared fill
    rises with each step and the search ends."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(lengths) // capacity)
    bins = [list(b) for b in bins]
    alive = {b for b in range(len(bins)) if bins[b]}
    open_bins = sorted((fill[b], b) for b in alive if fill[b] < capacity)

    def set_fill(b: int, value: int) -> None:
        at = bisect_left(open_bins, (fill[b], b))
        if at < len(open_bins) and open_bins[at] == (fill[b], b):
            open_bins.pop(at)
        fill[b] = value
        if 0 < value < capacity:
            insort(open_bins, (value, b))

    def improve(source: int) -> bool:
        """One step that shrinks ``source`` in favour of a bin at least as full."""
        for x in sorted(bins[source], key=lambda i: -lengths[i]):
            size = lengths[x]
            at = bisect_right(open_bins, (capacity - size, len(bins))) - 1
            while at >= 0 and open_bins[at][1] == source:
                at -= 1
            if at >= 0 and open_bins[at][0] + size > fill[source]:
                target = open_bins[at][1]  # move
                bins[source].remove(x)
                bins[target].append(x)
                set_fill(source, fill[source] - size)
                set_fill(target, fill[target] + size)
                return True
        for full, target in reversed(open_bins):
            if target == source or full < fill[source]:
                continue
            room = capacity - full
            own = sorted((lengths[i], i) for i in bins[target])
            for x in bins[source]:
                size = lengths[x]
                # one for one: the smallest piece of the target that still leaves room for x
                at = bisect_left(own, (size - room, -1))
                if at < len(own) and own[at][0] < size:
                    y, given = own[at][1], own[at][0]
                    bins[source][bins[source].index(x)] = y
                    bins[target][bins[target].index(y)] = x
                    set_fill(source, fill[source] - size + given)
                    set_fill(target, fill[target] + size - given)
                    return True
            mine = sorted((lengths[i], i) for i in bins[source])
            for given, y in own:
                # two for one: the largest pair that is more than y and fits
                best, high = None, len(mine) - 1
                for low in range(len(mine)):
                    while high > low and mine[low][0] + mine[high][0] > given + room:
                        high -= 1
                    if high <= low:
                        break
                    total = mine[low][0] + mine[high][0]
                    if total > given and (best is None or total > best[0]):
                        best = (total, mine[low][1], mine[high][1])
                if best:
                    total, a, b = best
                    bins[source] = [i for i in bins[source] if i not in (a, b)] + [y]
                    bins[target] = [i for i in bins[target] if i != y] + [a, b]
                    set_fill(source, fill[source] - total + given)
                    set_fill(target, fill[target] + total - given)
                    return True
        return False

    stuck: set[int] = set()  # bins that the present state of the others can't drain
    while len(alive) > least:
        source = next((b for _, b in open_bins if b not in stuck), None)
        if source is None:
            break
        moved = False
        while fill[source] and improve(source):
            moved = True
        if moved:
            stuck.clear()
        if fill[source]:
            stuck.add(source)
        else:
            alive.discard(source)
    return [bins[b] for b in sorted(alive)]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(lengths, best_fit(lengths, capacity), capacity)


def packed(table: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces; ``table`` must be a written one."""
    used = 0  # groups of the rounds before; sequence ids go on from there

    def dealt(rows: DataFrame) -> tuple[DataFrame, int]:
        nonlocal used
        groups, before = max(1, round(rows.count() / group_pieces)), used
        used += groups

        def run(frame):
            lengths = frame["length"].tolist()
            sequence, offset = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64)
            for k, members in enumerate(pack(lengths, capacity)):
                at = 0
                for i in members:
                    sequence[i], offset[i] = k, at
                    at += lengths[i]
            return frame.assign(sequence_id=(before + frame["_group"].to_numpy() << 32) + sequence, offset=offset).drop(columns="_group")

        rows = rows.withColumn("_group", F.pmod(F.xxhash64("tag", "piece", F.lit(before)) if before else F.xxhash64("tag", "piece"), F.lit(groups)))
        return rows.groupBy("_group").applyInPandas(run, f"{PIECES}, sequence_id long, offset long"), groups

    latest, groups = dealt(table)
    if groups == 1:
        return latest
    latest, done = cut(latest), []
    while groups > 1:
        bins = latest.groupBy("sequence_id").agg(F.sum("length").alias("_fill"))
        bins = cut(bins.where(F.col("_fill") <= OPEN_FILL * capacity).select("sequence_id"))
        count = bins.count()
        if count < 2:
            break
        few = F.broadcast(bins) if count <= BROADCAST_BINS else bins
        again, groups = dealt(cut(latest.join(few, "sequence_id", "left_semi").drop("sequence_id", "offset")))
        again = cut(again)
        if again.select("sequence_id").distinct().count() >= count:
            break
        done.append(latest.join(few, "sequence_id", "left_anti"))
        latest = again
    for part in done:
        latest = latest.unionByName(part)
    return latest


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    table = cut(pieces(docs, path or vocabulary_path(), capacity))
    return packed(table, capacity).drop("tag")
