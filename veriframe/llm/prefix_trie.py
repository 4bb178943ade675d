"""Prefix trie of conversations by van Emde Boas recursion.

Sequences of turns are cut at half depth, the halves again, down to single turns; all
subproblems of one depth of the recursion are solved in the same pass, so the passes grow with the
logarithm of the longest sequence.

1. *Names.* A turn is the 128-bit digest of its role and text; from there on no text moves. Going up, the
   name of a block of 2^k turns is the digest of its two halves' names.
2. *Upper trie and lower forests.* Going down, each sequence's prefix at a cut is named from the
   prefix at the block's start and the upper half's name; that names the root of the lower tree in which
   the second half lies. In the end every prefix has its name; those of equal names are
   one node, called by its smallest member and its depth.
3. *Grafting.* Going up again, block pairs are joined: the total of each lower tree is added to the ancestors
   of its root inside the upper half. They are looked up by (member, depth), one row each.

Turns are numbered within a conversation by ranges of (conv_id, turn, digest): equal turns are
counted first, ranges are of like size whatever the conversation, and only range totals meet
per conversation. Nodes with many members are joined by ``join_groups``. Members that end at one
node are joined to text in ordered pieces of ``PIECE`` ids and the pieces are streamed through
the digest, so no list of them is held.

Defined results: rows without conv_id belong to no conversation and are left out; null role and text
are empty; null turns come first; ties of a turn are ordered by the digest of role and text; repeated rows
are turns of their own; a conversation left without turns is a member of the root; an
empty table gives no row; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.hot_keys import join_groups
from veriframe.session import cut

#: Conversations c with the same c - c % FAMILY share the first turns of that one; at most SHARED - 1 of them.
FAMILY = 5
SHARED = 9
#: Ids of one piece of an ends list.
PIECE = 10_000
CHUNK = 10_000


def short_digest(*parts: Column) -> Column:
    """128 bits of the SHA-256 of the parts in a row; all but the last have fixed widths."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, name, bytes and the number of such turns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    role = F.coalesce(F.col("role").cast("string"), F.lit("")).cast("binary")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        short_digest(F.unhex(F.sha2(role, 256)), text).alias("name"), F.octet_length(text).cast("long").alias("bytes"),
    )
    return turns.groupBy("conv_id", "turn", "name", "bytes").agg(F.count(F.lit(1)).alias("n"))


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, range, pos within the range, name, bytes) of every turn, and the turns before each (conv_id, range)."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("name")]
    ranged = cut(turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("conv_id", "part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0)))
    # Alike turns are written out in pieces of bounded size.
    pieces = placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    if not ranged.where(F.col("n") > CHUNK).isEmpty():
        pieces = pieces.repartition("conv_id", "turn", "name", "piece")
    each = F.explode(F.sequence(F.col("piece"), F.least(F.col("piece") + (CHUNK - 1), F.col("n") - 1)))
    rows = pieces.select("conv_id", "part", "at", "name", "bytes", each.alias("copy"))
    rows = rows.select("conv_id", "part", (F.col("at") + F.col("copy")).alias("at"), "name", "bytes")
    totals = ranged.groupBy("conv_id", "part").agg(F.sum("n").alias("n"))  # a row a range and conversation
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, totals.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, name, bytes) of the rebuilt conversations, and (conv_id, length) of each."""
    rows, ranges = numbered(turn_rows(conversations))
    ranges = cut(ranges)
    lengths = ranges.groupBy("conv_id").agg(F.sum("n").alias("own"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = lengths.select("conv_id", "own", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    given = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(given, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = cut(convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    # Own turns: h and the turns taken are brought to the rows by (conversation, range), whose size is bounded.
    places = ranges.join(convs.select("conv_id", "h", "taken"), "conv_id").select("conv_id", "part", "before", "h", "taken")
    own = rows.join(places, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("at"))
    own = cut(own.select("conv_id", "pos", "h", "taken", "name", "bytes"))
    rest = own.where(F.col("pos") >= F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "name", "bytes")
    heads = own.where((F.col("pos") < SHARED - 1) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "pos", "name", "bytes")
    # A family has at most 2 * FAMILY - 1 conversations, a head SHARED - 1 turns.
    first = convs.select("conv_id", "base", "h").join(heads, "base").where(F.col("pos") < F.col("h")).select("conv_id", "pos", "name", "bytes")
    return cut(rest.unionByName(first)), convs.select("conv_id", "length")


def prefixes(turns: DataFrame, convs: DataFrame, longest: int) -> DataFrame:
    """(conv_id, depth, name, bytes) of every prefix of every sequence; ``bytes`` are those of its last turn.

    A depth with lowest bit 2^k is reached from the depth without that bit by one block of 2^k turns."""
    blocks = [turns.select("conv_id", F.col("pos").alias("block"), "name")]
    for _ in range(1, longest.bit_length()):
        odd = F.col("block") % 2 == 1
        halves = blocks[-1].groupBy("conv_id", F.shiftright("block", 1).alias("block"))
        pair = halves.agg(F.max(F.when(~odd, F.col("name"))).alias("left"), F.max(F.when(odd, F.col("name"))).alias("right"))
        whole = pair.where(F.col("left").isNotNull() & F.col("right").isNotNull())
        blocks.append(cut(whole.select("conv_id", "block", short_digest(F.col("left"), F.col("right")).alias("name"))))
    known = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").cast("binary").alias("name"))
    for k in range(longest.bit_length() - 1, -1, -1):
        size = F.lit(1 << k).cast("long")
        upper = blocks[k].where(F.col("block") % 2 == 0).select("conv_id", (F.col("block") * size).alias("depth"), F.col("name").alias("upper"))
        name = short_digest(F.lit(f"{k:4d}").cast("binary"), F.col("name"), F.col("upper"))
        fresh = known.join(upper, ["conv_id", "depth"]).select("conv_id", (F.col("depth") + size).alias("depth"), name.alias("name"))
        known = cut(known.unionByName(fresh))
    own = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "bytes")
    return known.join(own, ["conv_id", "depth"], "left").select("conv_id", "depth", "name", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def graft(own: DataFrame, nodes: DataFrame, links: DataFrame, longest: int, sums: list[str]) -> DataFrame:
    """(node, depth, sums) over the subtrees below depth 0.

    ``own`` has the values of every node, ``nodes`` its parent, ``links`` the node of each (conv_id, depth)."""
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums]
    totals = own.where("depth > 0").select("node", "depth", *zero)
    for k in range(max(longest - 1, 0).bit_length()):
        size = 1 << k
        # Lower trees of the pair: their tops lie just below a cut at an odd multiple of the block size.
        tops = totals.where(F.col("depth") % (2 * size) == size + 1 if size > 1 else F.col("depth") % 2 == 0)
        tops = tops.join(nodes.select("node", "depth", "parent"), ["node", "depth"])
        lower = tops.groupBy("parent", "depth").agg(*[F.sum(c).alias(c) for c in sums])
        above = F.explode(F.sequence(F.col("depth") - size, F.col("depth") - 1)).alias("up")
        paths = lower.select(F.col("parent").alias("conv_id"), above, *sums).withColumnRenamed("up", "depth")
        added = paths.join(links.select("conv_id", "depth", "node"), ["conv_id", "depth"]).select("node", "depth", *sums)
        totals = cut(totals.unionByName(added).groupBy("node", "depth").agg(*[F.sum(c).alias(c) for c in sums]))
    return totals


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of the nodes at which members end; ``ends`` has node, depth, conv_id."""
    counts = cut(ends.groupBy("node", "depth").agg(F.count(F.lit(1)).alias("size"), F.min("conv_id").alias("only")))
    single = counts.where("size = 1").select("node", "depth", F.sha2(F.col("only").cast("string").cast("binary"), 256).alias("ends_sha256"))
    several = join_groups(ends, counts.where("size > 1").select("node", "depth", "size"), ["node", "depth"], "size", "inner")
    piece_type = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ordered ids of a node, joined by commas, ``PIECE`` at a time."""
        key, held = None, []

        def out() -> pa.RecordBatch:
            row = (*key, held[0], ",".join(map(str, held)))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, piece_type, strict=True)], ["node", "depth", "first", "ids"])

        for batch in batches:
            for node, depth, conv_id in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if (node, depth) != key or len(held) == PIECE:
                    if held:
                        yield out()
                    key, held = (node, depth), []
                held.append(conv_id)
        if held:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, rows = None, None, []
        for batch in batches:
            for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if (node, depth) != key:
                    if key:
                        rows.append((*key, digest.hexdigest()))
                    key, digest = (node, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if key:
            rows.append((*key, digest.hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["node", "depth", "ends_sha256"])

    ordered = several.select("node", "depth", "conv_id").repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id")
    joined = ordered.mapInArrow(pieces, "node long, depth long, first long, ids string")
    joined = joined.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").select("node", "depth", "ids")
    return single.unionByName(joined.mapInArrow(digests, "node long, depth long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    turns, convs = rebuilt(conversations)
    longest = convs.agg(F.max("length")).first()[0] or 0
    rows = cut(prefixes(turns, convs, longest))
    named = rows.groupBy("name").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.any_value("depth").alias("depth"), F.any_value("bytes").alias("bytes"))
    named = cut(named)
    links = cut(join_groups(rows.select("conv_id", "depth", "name"), named.select("name", "node", "n_convs"), "name", "n_convs", "inner").drop("name"))
    above = links.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = cut(named.select("node", "depth", "n_convs", "bytes").join(above, ["node", "depth"], "left"))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = cut(nodes)
    sums = ["n_leaves", "saved_tokens"]
    totals = graft(nodes, nodes, links, longest, sums)
    tops = totals.where("depth = 1").groupBy().agg(*[F.sum(c).alias(c) for c in sums])  # one row: all trees below the root
    root = nodes.where("depth = 0").select("node", "depth", *[F.col(c).alias(f"_{c}") for c in sums]).crossJoin(F.broadcast(tops))
    root = root.select("node", "depth", *[(F.col(f"_{c}") + F.coalesce(c, F.lit(0))).alias(c) for c in sums])
    ends = links.join(convs.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("node", "depth", "conv_id")
    out = nodes.drop(*sums).join(totals.unionByName(root), ["node", "depth"]).join(end_digests(cut(ends)), ["node", "depth"], "left")
    return out.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def oracle() -> str:
    """The same in SQL: every prefix as a list, every pair of a prefix and one of its own prefixes."""
    from veriframe.llm.sharding import _crc_table

    crc = (
        "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), "
        "lambda p: ascii(substr(k, p, 1))::BIGINT)), lambda c, x: xor(c >> 8, (t.v)[1 + (xor(c, x) & 255)::INT])))"
    )
    return f"""
WITH t AS (SELECT {_crc_table()}::BIGINT[] AS v),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, sha256(concat(unhex(sha256(coalesce(role, ''))), encode(coalesce(text, ''))))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc} % {SHARED} AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS k FROM o), t),
b AS (
  SELECT c.conv_id, 0 AS own, o.pos, struct_pack(r := o.role, x := o.text) AS turn FROM c JOIN o ON o.conv_id = c.base WHERE o.pos < c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, struct_pack(r := o.role, x := o.text) FROM c JOIN o ON o.conv_id = c.conv_id WHERE o.pos >= c.h),
s AS (SELECT c.conv_id, coalesce(list(b.turn ORDER BY b.own, b.pos) FILTER (b.turn IS NOT NULL), []) AS turns FROM c LEFT JOIN b USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, len(turns) AS n, d AS depth, turns[1:d] AS node FROM s, unnest(range(0, len(turns) + 1)) u(d)),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256,
        (count(*) - 1) * coalesce(octet_length(encode(any_value(node)[depth].x)), 0) AS saved FROM p GROUP BY node, depth),
k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.node = n.node),
a AS (SELECT node[1:u.d] AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM m, unnest(range(0, depth + 1)) u(d) GROUP BY 1)
SELECT m.conv_id, m.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
  a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN a ON a.node = m.node LEFT JOIN n q ON m.depth > 0 AND q.node = m.node[1:m.depth - 1]"""
