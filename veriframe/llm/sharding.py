"""Rendezvous hashing of record keys over weighted shards.

Every (key, shard) pair has a hash u in (0, 1); the shard with the least -ln(u) / weight
takes the record. A shard's score depends on itself alone, so one more shard takes records
only into itself, and about its share of the weight.

Slots number the rows of a shard without gaps. Rows are cut into hash buckets, equal rows
are counted first, and bucket totals give each bucket its first slot, so no window holds a
whole shard and one row repeated very often is one row until the last step.

Defined results: a null key hashes as the empty text and is a key of its own; equal keys go
to one shard; a null text has no bytes; an empty table gives no row. ``with_shard`` keeps
all columns and replaces a clashing name; ``with_slots`` returns the contract's columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.session import cut

SHARDS = 8
BUCKETS = 4096
#: Copies of one row written by one output row of the expansion.
CHUNK = 10_000


def _score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight with u from the leading 48 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{shard}:"), key).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / F.lit(float(weight))


def with_shard(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """Add the shard number of every record."""
    if any(w <= 0 for w in weights):
        raise ValueError("weights are above zero")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    scores = [F.struct(_score(text, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    best = F.array_min(F.array(*scores))["shard"] if len(scores) > 1 else F.lit(0)
    return df.withColumn(out, best)


def with_slots(records: DataFrame) -> DataFrame:
    """Number rows (doc_id, size, text_crc32, shard, grown_shard) within their shard."""
    row = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    digest = F.md5(F.concat(F.lit("slot:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(BUCKETS))
    rows = cut(records.groupBy(*row, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")))
    within = Window.partitionBy("shard", "_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    placed = rows.withColumn("_at", F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_m")).withColumn("_first", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    # At most shards x BUCKETS rows, whatever the input.
    placed = placed.join(F.broadcast(starts.select("shard", "_bucket", "_first")), ["shard", "_bucket"])
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(CHUNK).cast("long")))
    parts = placed.select("*", part.alias("_part")).repartition("doc_id", "_part")
    each = F.explode(F.sequence(F.col("_part"), F.least(F.col("_part") + (CHUNK - 1), F.col("_n") - 1)))
    slot = (F.col("_first") + F.col("_at") + F.col("_copy")).cast("long")
    return parts.select("*", each.alias("_copy")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every document under the ``key`` law, and its shard with one more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    both = with_shard(with_shard(sized, "doc_id", [1.0] * shards), "doc_id", [1.0] * (shards + 1), "grown_shard")
    return with_slots(both)


#: The same in SQL. Its engine has no crc32, so the checksum is folded over the bytes with the
#: table of the reflected polynomial 0xEDB88320, made here by its rule.
def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


def oracle(shards: int = SHARDS) -> str:
    def best(n: int) -> str:
        scores = ", ".join(f"{{'s': -ln((('0x' || substr(md5('{i}:' || k), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0), 'i': {i}}}" for i in range(n))
        return f"list_min([{scores}]).i"

    fold = (
        "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(b)::BIGINT), "
        "lambda p: ('0x' || substr(h, (2 * p + 1)::BIGINT, 2))::BIGINT)), lambda c, x: xor(c >> 8, (t.v)[1 + (xor(c, x) & 255)::INT])))"
    )
    return f"""
WITH t AS (SELECT {_crc_table()}::BIGINT[] AS v),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, octet_length(b)::BIGINT + 1 AS size, {fold} AS text_crc32,
  {best(shards)} AS shard, {best(shards + 1)} AS grown_shard,
  ('0x' || substr(md5('slot:' || k), 1, 8))::BIGINT % {BUCKETS} AS bucket FROM d, t)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard
FROM s"""
