"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints: bit i is set when it is set in over half of the hashes of a text's word
3-shingles. Two fingerprints link at 3 or fewer differing bits.

The join is a walk over pairs of trie nodes: both nodes go down a bit, the differing bits
add up, and a pair over the budget is pruned with all below it. By the pigeonhole
principle two linked fingerprints agree in one of four 16-bit blocks, so the trie is walked
for each block brought to the front, with a budget of none over its first 16 levels. A subtree
under such a block is a unit of work; a unit with over ``UNIT_ROWS`` fingerprints is split
into pairs of its nodes some levels further down. Within a task the pairs are folded
into a forest, so groups of copies leave the task as trees, never as all their pairs.

Defined results: a null text, or one without words, has fingerprint zero and links like any
other; repeated rows share a fingerprint; a null doc_id counts after all others as a
component's name; an empty table gives no row. ``near_dedup`` keeps all columns of one row
per component, the least doc_id (then the first row), whatever their names but the reserved
``MARK`` and ``ROW``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veriframe.llm.components import Forest, components
from veriframe.session import checkpoint_dir, cut

BITS = 64
BUDGET = 3
BLOCK = 16
SHINGLE = 3
SEED = 42
#: Reserved columns of ``near_dedup``.
MARK, ROW = "__simhash_mark", "__simhash_row"
UNIT_ROWS = 4096
#: Rows of the join in one task, about.
TASK_ROWS = 300_000
#: Node pairs that a task expands at once.
FRONTIER = 500_000


def fingerprint(text: str | None) -> int:
    """SimHash of a text as a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(s, SEED) for s in shingles], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    value = sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())
    return value - (1 << BITS) if value >> (BITS - 1) else value


def with_fingerprint(docs: DataFrame, out: str = "_fp") -> DataFrame:
    """Every row with the fingerprint of its ``text`` as a long."""
    docs = docs.drop(out)
    schema, at = StructType([*docs.schema.fields, StructField(out, LongType())]), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([fingerprint(t.as_py()) for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def trie_join(keys: np.ndarray, pairs: np.ndarray, forest: Forest) -> None:
    """Walk node pairs over sorted ``keys`` (uint64).

    ``pairs``: rows (start, end, start, end, differing bits, depth) of node pairs; a node is the
    range of keys under it."""
    stack = [pairs]
    while stack:
        todo = stack.pop()
        if len(todo) > FRONTIER:
            stack += [todo[at : at + FRONTIER] for at in range(0, len(todo), FRONTIER)]
            continue
        a0, a1, b0, b1, bits, depth = todo.T
        same = (a0 == b0) & (a1 == b1)
        small = (a1 - a0 == 1) & (b1 - b0 == 1)
        done = small & ~same
        if done.any():
            i, j = a0[done], b0[done]
            linked = np.bitwise_count(keys[i] ^ keys[j]) <= BUDGET
            forest.unite(i[linked], j[linked])
        go = todo[~small & (depth < BITS)]
        if not len(go):
            continue
        a0, a1, b0, b1, bits, depth = go.T
        shift = (BITS - 1 - depth).astype(np.uint64)
        one = np.uint64(1)

        def split(lo, hi):
            """First position in each range whose next bit is set."""
            lo, hi = lo.copy(), hi.copy()
            while True:
                open_ = lo < hi
                if not open_.any():
                    return lo
                mid = (lo + hi) >> 1
                is_set = (keys[np.minimum(mid, len(keys) - 1)] >> shift & one).astype(bool)
                hi = np.where(open_ & is_set, mid, hi)
                lo = np.where(open_ & ~is_set, mid + 1, lo)

        am, bm = split(a0, a1), split(b0, b1)
        twin = (a0 == b0) & (a1 == b1)
        next_ = []
        for x0, x1, y0, y1, extra, mirrored in ((a0, am, b0, bm, 0, False), (am, a1, bm, b1, 0, False), (a0, am, bm, b1, 1, False), (am, a1, b0, bm, 1, True)):
            keep = (x1 > x0) & (y1 > y0) & (bits + extra <= BUDGET)
            if mirrored:
                keep &= ~twin  # a node with itself: one of the two crossings is enough
            keep &= ~((x0 == y0) & (x1 == y1) & (x1 - x0 == 1))
            next_.append(np.column_stack([x0, x1, y0, y1, bits + extra, depth + 1])[keep])
        grown = np.concatenate(next_)
        if len(grown):
            stack.append(grown)


def _units(prints: DataFrame) -> DataFrame:
    """(unit, fp, key): every fingerprint under each unit of work that it belongs to."""
    u = F.col("fp")

    def turned(k: int):
        return u if k == 0 else F.shiftleft(u, BLOCK * k).bitwiseOR(F.shiftrightunsigned(u, BITS - BLOCK * k))

    blocks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), turned(k).alias("key")) for k in range(BITS // BLOCK)]))
    rows = prints.select("fp", blocks.alias("_b")).select("fp", F.col("_b.k").alias("k"), F.col("_b.key").alias("key"))
    rows = rows.withColumn("top", F.shiftrightunsigned("key", BITS - BLOCK))
    sizes = rows.groupBy("k", "top").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > UNIT_ROWS)
    levels = F.least(F.ceil(F.log2(F.col("n") / UNIT_ROWS)) + 2, F.lit(12)).cast("int")
    sizes = cut(sizes.select("k", "top", levels.alias("q")))
    large = F.broadcast(sizes) if sizes.count() <= 100_000 else sizes
    rows = rows.join(large, ["k", "top"], "left").withColumn("q", F.coalesce("q", F.lit(0)))
    node = F.when(F.col("q") == 0, F.lit(0)).otherwise(F.expr("CAST(shiftrightunsigned(shiftleft(key, 16), 64 - q) AS INT)"))
    rows = rows.withColumn("node", node)
    masks = F.filter(F.sequence(F.lit(0), F.shiftleft(F.lit(1), 12) - 1), lambda m: F.bit_count(m) <= BUDGET)
    own = F.when(F.col("q") == 0, F.array(F.lit(0))).otherwise(F.filter(masks, lambda m: m < F.expr("CAST(pow(2, q) AS INT)")))
    rows = rows.select("*", F.explode(own).alias("mask"))
    other = F.col("node").bitwiseXOR(F.col("mask"))
    return rows.select("fp", "key", "k", "top", "q", F.least("node", other).alias("u"), F.greatest("node", other).alias("v"))


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) of a forest that connects the linked distinct fingerprints ``fp``."""
    units = _units(prints)
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * prints.count() // TASK_ROWS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        col = {n: table.column(n).to_numpy() for n in ("fp", "key", "k", "top", "q", "u", "v")}
        key = col["key"].view(np.uint64) if col["key"].dtype == np.int64 else col["key"].astype(np.int64).view(np.uint64)
        order = np.lexsort((key, col["v"], col["u"], col["top"], col["k"]))
        key = key[order]
        unit = np.column_stack([col[n][order].astype(np.int64) for n in ("k", "top", "u", "v", "q")])
        first = np.concatenate([[True], (unit[1:, :4] != unit[:-1, :4]).any(axis=1)])
        starts = np.flatnonzero(first)
        ends = np.concatenate([starts[1:], [len(key)]])
        u, v, q = unit[starts, 2], unit[starts, 3], unit[starts, 4]
        # A split unit of two nodes: the keys of u stand before those of v.
        shift = np.minimum(BITS - BLOCK - q, 63).astype(np.uint64)
        nodes = (key << np.uint64(BLOCK) >> np.uint64(BLOCK)) >> np.repeat(shift, ends - starts)
        is_v = (nodes != np.repeat(u, ends - starts).astype(np.uint64)) & np.repeat(u != v, ends - starts)
        ahead = np.concatenate([[0], np.cumsum(~is_v)])
        middle = np.where(u == v, ends, starts + ahead[ends] - ahead[starts])
        pairs = np.column_stack([
            starts, middle, np.where(u == v, starts, middle), ends, np.bitwise_count((u ^ v).astype(np.uint64)).astype(np.int64), BLOCK + q,
        ])
        pairs = pairs[(pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & ~((u == v) & (ends - starts == 1))]
        forest = Forest(len(key))
        trie_join(key, pairs, forest)
        a = np.flatnonzero(forest.label != np.arange(len(key)))
        fp = col["fp"][order]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(fp[a], pa.int64()), pa.array(fp[forest.label[a]], pa.int64())], ["a", "b"])

    return units.repartition(tasks, "k", "top", "u", "v").mapInArrow(run, "a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """(fp, cls) of every distinct fingerprint: one label per component."""
    distinct = cut(prints.select(F.col("_fp").alias("fp")).distinct())
    labels = components(links(distinct)).select(F.col("node").alias("fp"), "component")
    return cut(distinct.join(labels, "fp", "left").select("fp", F.coalesce("component", "fp").alias("cls")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document."""
    marked = cut(with_fingerprint(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "_fp"))
    of = classes(marked)
    least = marked.groupBy("_fp").agg(F.min("doc_id").alias("m")).join(of, F.col("_fp") == F.col("fp"))
    names = least.groupBy("cls").agg(F.min("m").alias("component_id"))
    named = of.join(names, "cls").select(F.col("fp").alias("_fp"), "component_id")
    text = F.lower(F.lpad(F.hex("_fp"), 16, "0"))
    # A fingerprint shared by very many documents skews this join; Spark splits its side.
    return marked.join(named, "_fp").select("doc_id", text.alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each component: the least doc_id, then the first row; all columns stay."""
    spark = docs.sparkSession
    table = f"{checkpoint_dir(spark).rstrip('/')}/simhash-{uuid.uuid4().hex}"
    with_fingerprint(docs, MARK).withColumn(ROW, F.monotonically_increasing_id()).write.parquet(table)
    rows = spark.read.parquet(table)
    small = rows.select("doc_id", F.col(MARK).alias("_fp"), ROW)
    best = small.groupBy("_fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", ROW)).alias("m"))
    of = classes(small)
    kept = best.join(of, F.col("_fp") == F.col("fp")).groupBy("cls").agg(F.min("m").alias("m")).select(F.col(f"m.{ROW}").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*docs.columns)
